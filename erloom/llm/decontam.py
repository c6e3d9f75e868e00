"""Benchmark decontamination by greedy string tiling.

Documents and test items meet on shared seeds of SEED words. For each pair whose seeds could cover enough of the
item, the longest common stretches are found by running Karp-Rabin hashes, marked and excluded, again and again
down to MIN_MATCH words; the share of the item that ends up under tiles decides. Tiles may lie in any order, so a
passage whose parts were moved is still caught."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, small_batches, split_words, table
from .minhash import word_hashes

#: A tile has so many words at least; seeds are as long, so that no tile is missed.
MIN_MATCH = 4
COVERAGE = 0.6
#: Text of test items that one pass over the documents broadcasts, in characters.
ITEM_CHARS = 4_000_000
#: Places of seeds in test items that are laid out at once; those of one document always are.
PLACES = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def running_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of each stretch of n words."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _BASE, dtype=np.uint64)]), dtype=np.uint64)
        # prefix sums of words[i] * base ** i, compared after shifting both to the same power
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power[:-1], dtype=np.uint64)])
        if len(words) < n:
            return np.zeros(0, dtype=np.uint64)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), inverse, dtype=np.uint64)]), dtype=np.uint64)
        return (sums[n:] - sums[:-n]) * back[: len(words) - n + 1]


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word arrays: (start in item, start in doc, length) of every tile.

    In each round every unmarked match as long as the longest one left is marked, earlier ones first."""
    free_a, free_b, out = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool), []
    n = min(len(item), len(doc))
    while n >= least:
        # the longest length at which a stretch unmarked on both sides has an equal hash
        lo, hi, found = least, n, None
        while lo <= hi:
            mid = (lo + hi) // 2
            pairs = _equal(item, doc, free_a, free_b, mid)
            if pairs is not None:
                found, lo = (mid, pairs), mid + 1
            else:
                hi = mid - 1
        if found is None:
            break
        n, pairs = found
        for i, j in pairs:
            if free_a[i : i + n].all() and free_b[j : j + n].all():
                free_a[i : i + n] = free_b[j : j + n] = False
                out.append((int(i), int(j), n))
    return out


def _equal(item: np.ndarray, doc: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, n: int):
    whole = lambda f: (lambda c: c[n:] - c[:-n] == n)(np.concatenate([[0], np.cumsum(f)]))
    a, b = running_hashes(item, n), running_hashes(doc, n)
    ia, ib = np.flatnonzero(whole(free_a)), np.flatnonzero(whole(free_b))
    ib = ib[np.isin(b[ib], a[ia])]
    if not len(ib):
        return None
    at: dict[int, list[int]] = {}
    for j in ib.tolist():
        at.setdefault(int(b[j]), []).append(j)
    pairs = [(i, j) for i in ia.tolist() for j in at.get(int(a[i]), ()) if (item[i : i + n] == doc[j : j + n]).all()]
    return pairs or None


class _Items:
    """Word arrays of test items with a sorted table of their seeds; items shorter than a seed by the hash of all words."""

    def __init__(self, ids: list[int], texts: list[str]):
        starts, codes, distinct = split_words(pa.array(texts, pa.large_string()))
        known = word_hashes(distinct)
        self.ids, self.words, self.short = ids, [], {}
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            w = known[codes[a:b]]
            w = w[w != 0]
            self.words.append(w)
            if 0 < len(w) < MIN_MATCH:
                self.short.setdefault(w.tobytes(), []).append(len(self.words) - 1)
        seeds = [running_hashes(w, MIN_MATCH) for w in self.words]
        seed = np.concatenate(seeds) if seeds else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, dtype=np.int64)
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner, self.place = seed[order], owner[order], place[order]
        self.distinct = np.unique(self.seed)


def find(items: _Items, texts: pa.Array, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item_id, coverage, tiles, longest tile) of every contaminated pair among the texts."""
    starts, codes, vocabulary = split_words(texts)
    words = word_hashes(vocabulary)[codes] if len(codes) else np.zeros(0, dtype=np.uint64)
    keep = words != 0
    ends = np.concatenate([[0], np.cumsum(keep)])[starts]
    words = words[keep]
    hashes = running_hashes(words, MIN_MATCH)
    hit = np.flatnonzero(np.isin(hashes, items.distinct)) if len(items.distinct) else np.zeros(0, dtype=np.int64)
    doc = np.searchsorted(ends, hit, side="right") - 1
    if len(hit):
        inside = hit + MIN_MATCH <= ends[doc + 1]
        hit, doc = hit[inside], doc[inside]
    out = []
    # a seed counts once in a document; its places in the items are laid out some documents at a time
    new = np.unique(np.stack([doc, hashes[hit].view(np.int64)], axis=1), axis=0) if len(hit) else np.zeros((0, 2), dtype=np.int64)
    doc, seed = new[:, 0], np.ascontiguousarray(new[:, 1]).view(np.uint64)
    lo, hi = np.searchsorted(items.seed, seed, "left"), np.searchsorted(items.seed, seed, "right")
    total = np.concatenate([[0], np.cumsum(hi - lo)])
    bounds = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), len(doc)) if len(doc) else np.array([0])
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(total[bounds], total[bounds[at]] + PLACES, side="right")) - 1)
        own = slice(bounds[at], bounds[to])
        out += _judge(items, words, ends, doc[own], lo[own], hi[own], threshold)
        at = to
    if items.short:
        n = np.diff(ends)
        for d in np.flatnonzero((n > 0) & (n < MIN_MATCH)):
            out += [(int(d), items.ids[k], 1.0, 1, int(n[d])) for k in items.short.get(words[ends[d] : ends[d + 1]].tobytes(), ())]
    return out


def _judge(items: _Items, words: np.ndarray, ends: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """Contaminated pairs from the seeds items.seed[lo:hi] of each document: those that seeds could cover are tiled."""
    n = hi - lo
    k = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
    size = np.fromiter(map(len, items.words), dtype=np.int64, count=len(items.words))
    pair = np.repeat(doc, n) * len(size) + items.owner[k]
    order = np.argsort(pair, kind="stable")
    pair, place = pair[order], items.place[k[order]]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(pair))
    which = pair[first] % len(size) if len(first) else first
    out = []
    for f, e, i, d in zip(*(x[(last - first) * MIN_MATCH >= threshold * size[which]].tolist() for x in (first, last, which, pair[first] // max(1, len(size)))), strict=True):
        under = np.zeros(size[i] + 1, dtype=np.int64)
        np.add.at(under, place[f:e], 1)
        np.add.at(under, place[f:e] + MIN_MATCH, -1)
        if (np.cumsum(under)[:-1] > 0).mean() < threshold:  # tiles cover no more than seeds do
            continue
        own = tiles(items.words[i], words[ends[d] : ends[d + 1]])
        share = sum(t[2] for t in own) / size[i]
        if share >= threshold:
            out.append((d, items.ids[i], share, len(own), max(t[2] for t in own)))
    return out


def _search(held, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch):
                found = find(held.value, texts, threshold)
                names = rows.column("doc_id").to_pylist()
                cols = list(zip(*((names[d], *rest) for d, *rest in found), strict=True)) or [[], [], [], [], []]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "coverage", "n_tiles", "longest"])

    return run


def _clean(held, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch):
                keep = np.ones(len(texts), dtype=bool)
                keep[[f[0] for f in find(held.value, texts, threshold)]] = False
                yield rows.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame) -> list:
    """Broadcast test items, ITEM_CHARS characters at a time."""
    sc = benchmark.sparkSession.sparkContext
    block, size, blocks = [], 0, []
    for item_id, text in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((item_id, text))
        size += len(text)
        if size >= ITEM_CHARS:
            blocks.append(sc.broadcast(_Items(*map(list, zip(*block, strict=True)))))
            block, size = [], 0
    blocks.append(sc.broadcast(_Items(*map(list, zip(*block, strict=True))) if block else _Items([], [])))
    return blocks


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """The rows of docs, all columns, that hold no test item. Null and empty texts hold none and stay; repeated rows are
    judged alike; an empty table or benchmark removes nothing. All blocks of items run in one pass over the documents."""
    for held in _blocks(benchmark):
        docs = small_batches(docs).mapInArrow(_clean(held, threshold), docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) of every pair of a document and a test item of which tiles
    cover `threshold` or more of the words.

    Items go out in blocks of ITEM_CHARS characters, one pass over the documents for each, so what is broadcast
    is bounded whatever the size of the benchmark. An item of fewer than MIN_MATCH words is held by the documents that
    have its words and no others. Null and empty items and null or empty documents match nothing; items of the same text
    are items of their own; repeated rows are searched once each; of matches as long as each other the earlier in the
    item goes first; other columns are ignored. An empty table or benchmark gives no rows."""
    passes = [small_batches(docs).select("doc_id", "text").mapInArrow(_search(b, threshold), "doc_id long, item_id long, coverage double, n_tiles long, longest long") for b in _blocks(benchmark)]
    out = passes[0]
    for p in passes[1:]:
        out = out.unionAll(p)
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a test item that it holds, in order or not."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
