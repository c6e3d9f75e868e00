"""Near-duplicate documents by DartMinHash over five-word shingles, each weighted by its count in the text.

Each shingle of weight w owns the strip [0, w) x [0, inf) of a (weight, rank) plane in which a fixed random
process has thrown darts. A document sees the darts inside its own strips up to a rank chosen from its total
weight, about k ln k + 2k of them whatever its length, and keeps the earliest dart for each of k coordinates.
Two documents keep the same dart at a coordinate with the probability of their weighted Jaccard similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import GOLDEN, _M1, _M2, chunks, components, mix, small_batches, split_words, staged, table

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 30 bands of 5 coordinates: a pair at similarity 0.8 meets in no band with a probability under 1e-5.
BANDS, ROWS = 30, 5
#: Members of a bucket whose pairs are listed; those of a larger bucket are compared in tiles.
SMALL_BUCKET = 8
#: Members on a side of a tile, and different shingles that a tile multiplies at once.
TILE, TILE_SHINGLES = 256, 8192
#: Rank cells below 1 are [0, FIRST), [FIRST, 2 FIRST), ... ; above 1 they have length 1.
FIRST = 2.0**-3
_ONE = 1 << 48  # fixed point of ranks
BLOCK = 60_000


def word_hashes(words: list[str]) -> np.ndarray:
    """Of each word's letters and digits in lower case; 0 if it has none, which drops it."""
    plain = [w if w.isalnum() else "".join(filter(str.isalnum, w)) for w in words]
    h = pd.util.hash_array(np.array([w.lower() for w in plain], dtype=object), categorize=False) | np.uint64(1)
    h[np.fromiter((not w for w in plain), dtype=bool, count=len(plain))] = 0
    return h


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each text's shingles with one end more, hashes of each text's distinct shingles, their counts).

    Words are white-space tokens without marks, in lower case. A text of one to four words has one shingle
    of them all; a text without words has none."""
    starts, codes, vocabulary = split_words(texts)
    texts_n = len(starts) - 1
    words = word_hashes(vocabulary)[codes] if len(codes) else np.zeros(0, dtype=np.uint64)
    keep = words != 0
    ends = np.concatenate([[0], np.cumsum(keep)])[starts]
    words, n = words[keep], np.diff(ends)
    with np.errstate(over="ignore"):
        h = mix(words, 0)
        for i in range(1, SHINGLE_WORDS):
            h[: max(0, len(words) - i)] = h[: max(0, len(words) - i)] * np.uint64(0x100000001B3) + words[i:]
    full = np.ones(len(words), dtype=bool)
    for i in range(1, SHINGLE_WORDS):  # the last words of a text begin no shingle
        full[(ends[1:] - i)[n >= i]] = False
    for d in np.flatnonzero((n > 0) & (n < SHINGLE_WORDS)):
        s, whole = ends[d], np.uint64(n[d])
        full[s] = True
        for w in words[s : s + n[d]]:
            whole = mix(np.array([whole ^ w], dtype=np.uint64))[0]
        h[s] = whole
    h = mix(h[full])
    doc = np.repeat(np.arange(texts_n), np.where(n > 0, np.maximum(1, n - SHINGLE_WORDS + 1), 0))
    first, counts = _counted(mix(h ^ mix(doc.astype(np.uint64))))
    return np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=texts_n))]), h[first], counts[first]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys are the first of their value, how often the value occurs, given there)."""
    first, counts = np.ones(len(keys), dtype=bool), np.ones(len(keys), dtype=np.int64)
    ordered = np.sort(keys)
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(repeated):  # few, so a table of their leading bits spares the search for the rest
        table = np.zeros(1 << 20, dtype=bool)
        table[repeated >> np.uint64(44)] = True
        at = np.flatnonzero(table[keys >> np.uint64(44)])
        at = at[repeated[np.minimum(np.searchsorted(repeated, keys[at]), len(repeated) - 1)] == keys[at]]
        at = at[np.argsort(keys[at], kind="stable")]
        begin = np.flatnonzero(np.concatenate([[True], keys[at][1:] != keys[at][:-1]]))
        first[at] = False
        first[at[begin]] = True
        counts[at[begin]] = np.diff(np.append(begin, len(at)))
    return first, counts


def strips(starts: np.ndarray, elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the element, hash, weight of at most 1) of each strip of a unit of weight. With whole weights the share
    of common strips of two sets is their weighted Jaccard similarity."""
    units = np.ceil(weights).astype(np.int64)
    which = np.repeat(np.arange(len(elements)), units)
    unit = np.arange(len(which)) - np.repeat(np.cumsum(units) - units, units)
    with np.errstate(over="ignore"):
        h = mix(elements[which] ^ (unit.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return which, h, np.minimum(1.0, weights[which] - unit)


def _throw(h: np.ndarray, wide: np.ndarray, at: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of elements h in ranks [at, at + length) and weights [0, wide), wide at most 1:
    (index of the element, fixed-point rank, 64 random bits)."""
    with np.errstate(over="ignore"):
        h = h ^ ((at / FIRST).astype(np.uint64) * np.uint64(GOLDEN) + np.uint64(11))
        u = h * _M1
        u ^= u >> np.uint64(32)
        u *= _M2
    found: list[tuple] = []
    p = np.exp(-length)
    below, n = p, 0
    limit = lambda x: np.uint64(min(x * 2.0**64, 2.0**64 - 4096))
    live = np.flatnonzero(u >= limit(below))
    while len(live) and n < 40:
        bits = mix(h[live], 500_011 + n)
        rank = (at if len(at) == 1 else at[live]) + length * (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53
        more = mix(bits, 3)
        inside = np.ones(len(live), dtype=bool) if (wide[live] >= 1).all() else (mix(bits, 5) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < wide[live]
        found.append((live[inside], (rank[inside] * _ONE).astype(np.uint64), more[inside]))
        n += 1
        p *= length / n
        below += p
        live = live[u[live] >= limit(below)]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(starts: np.ndarray, elements: np.ndarray, weights: np.ndarray | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """k coordinates for each set elements[starts[i]:starts[i + 1]] with positive weights (1 each by default);
    an empty set has the coordinate of the largest number. Equal coordinates are equal darts."""
    sets = len(starts) - 1
    size = np.diff(starts)
    if len(elements) <= BLOCK or len(size) < 2:
        return _signatures(starts, elements, weights, k)
    # sets of like size go together, a few at a time, so that they end at like ranks and stay in the cache
    order = np.argsort(size, kind="stable")
    ends = np.concatenate([[0], np.cumsum(size[order])])
    moved = np.arange(len(elements)) + np.repeat(starts[:-1][order] - ends[:-1], size[order])
    elements, weights = elements[moved], None if weights is None else np.asarray(weights)[moved]
    out, at = np.empty((len(size), k), dtype=np.uint64), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, side="right")) - 1)
        part = slice(ends[at], ends[to])
        out[order[at:to]] = _signatures(ends[at : to + 1] - ends[at], elements[part], None if weights is None else weights[part], k)
        at = to
    return out


def _signatures(starts: np.ndarray, elements: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    sets = len(starts) - 1
    doc = np.repeat(np.arange(sets), np.diff(starts))
    w = np.ones(len(elements)) if weights is None else np.asarray(weights, dtype=np.float64)
    if weights is not None:  # one strip for each unit of weight
        which, elements, w = strips(starts, elements, w)
        doc = doc[which]
    total = np.bincount(doc, weights=w, minlength=sets)
    out = np.full(sets * k, np.iinfo(np.uint64).max, dtype=np.uint64)
    goal = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-12), 0.0)
    at, done = 0.0, total <= 0
    live = np.arange(len(elements))
    while not done.all():
        # the next cell below 1, all cells up to twice the rank above
        length, cells = (FIRST if at == 0 else min(1.0, at)), max(1, int(at))
        row = live if cells == 1 else np.repeat(live, cells)
        index, rank, bits = _throw(elements[row], w[row], np.array([at]) if cells == 1 else np.tile(at + np.arange(cells), len(live)), length)
        if len(index):
            np.minimum.at(out, doc[row[index]] * k + (bits % np.uint64(k)).astype(np.int64), rank)
        at += length * cells
        # a set is done past its goal, with a dart at every coordinate
        past = np.flatnonzero(~done & (at >= goal))
        done[past[(out.reshape(sets, k)[past] != np.iinfo(np.uint64).max).all(axis=1)]] = True
        live = live[~done[doc[live]]]
    return out.reshape(sets, k)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.zeros((len(sig), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            keys[:, b] = b
            for r in range(rows):
                keys[:, b] = mix(keys[:, b] * np.uint64(0x100000001B3) ^ sig[:, b * rows + r], 17)
    return keys


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in chunks(batch):
            starts, sh, counts = shingles(texts)
            keys = band_keys(signatures(starts, sh, counts))
            some = np.diff(starts) > 0
            ends = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))])
            digest = [hashlib.md5(t.encode()).hexdigest() if t else None for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(digest, pa.string()), _lists(ends, keys[some].reshape(-1))], ["doc_id", "digest", "bands"])


def _shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strips of each text's shingles."""
    for batch in batches:
        for rows, texts in chunks(batch):
            starts, sh, counts = shingles(texts)
            _, units, _ = strips(starts, sh, counts)
            ends = np.concatenate([[0], np.cumsum(counts)])[starts]
            yield pa.RecordBatch.from_arrays([rows.column("node"), _lists(ends, units)], ["node", "sh"])


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (x, y) whose weighted shingles have a Jaccard similarity of threshold or more."""
    s = lambda k: sets.select(F.col("node").alias(k), F.col("sh").alias(f"s{k}"), F.size("sh").alias(f"n{k}"))
    both = pairs.join(s("x"), "x").join(s("y"), "y").where(F.least("nx", "ny") >= threshold * F.greatest("nx", "ny"))
    common = F.size(F.array_intersect("sx", "sy"))
    return both.withColumn("c", common).where(F.col("c") >= threshold * (F.col("nx") + F.col("ny") - F.col("c"))).select("x", "y")


def _tile(threshold: float):
    """Links between the components of a tile's members: of side 0 with side 1, or among side 0 if that is all. A link
    joins two components that no earlier link of the tile has joined."""

    def run(rows: pa.Table) -> pa.Table:
        side, ids, c = (np.asarray(rows.column(k)) for k in ("side", "x", "c"))
        sh = rows.column("sh").combine_chunks()
        starts = np.asarray(sh.offsets).astype(np.int64)
        n, values = np.diff(starts), np.asarray(sh.values)[starts[0] : starts[-1]]
        row = np.repeat(np.arange(len(n)), n)
        code = np.unique(values, return_inverse=True)[1]
        # what one text alone holds is common to no pair
        shared = np.bincount(code) > 1
        row, code = row[shared[code]], (np.cumsum(shared) - 1)[code[shared[code]]]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        b = b if len(b) else a
        common = np.zeros((len(a), len(b)))
        for at in range(0, int(shared.sum()), TILE_SHINGLES):
            part = slice(*np.searchsorted(code, [at, at + TILE_SHINGLES]))
            held = np.zeros((len(n), TILE_SHINGLES), dtype=np.float32)
            held[row[part], code[part] - at] = 1
            common += held[a] @ held[b].T
        i, j = np.nonzero((common >= threshold * (n[a][:, None] + n[b][None, :] - common)) & (c[a][:, None] != c[b][None, :]))
        own, which = np.unique(c, return_inverse=True)
        first = np.unique(which[a[i]] * len(own) + which[b[j]], return_index=True)[1]
        root, x, y = list(range(len(own))), [], []
        for k in first:
            u, v = which[a[i[k]]], which[b[j[k]]]
            while root[u] != u:
                u = root[u]
            while root[v] != v:
                v = root[v]
            if u != v:
                root[u] = v
                x.append(ids[a[i[k]]])
                y.append(ids[b[j[k]]])
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return run


def _tiled(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (x, y) between members (band, x, c) of one bucket whose components c differ; every such pair is compared.

    A component that fills a tile by itself has blocks of its own, which don't meet each other; the smaller ones of
    a bucket share blocks."""
    held = rest.groupBy("band", "c").agg(F.count("*").alias("n")).withColumn("g", F.when(F.col("n") > TILE, F.col("c")))
    size = held.groupBy("band", "g").agg(F.ceil(F.sum("n") / TILE).alias("blocks"))
    held = held.alias("h").join(size.alias("s"), F.expr("h.band = s.band and h.g <=> s.g")).select("h.band", "h.c", "h.g", "s.blocks")
    placed = rest.join(held, ["band", "c"]).select("band", "x", "c", F.struct(F.col("g").isNotNull().alias("alone"), F.coalesce("g", F.lit(0)).alias("g"), F.pmod(F.xxhash64("x"), F.col("blocks")).alias("i")).alias("block"))
    placed = staged(placed, "placed")
    block = placed.select("band", "block").distinct()
    tiles = block.withColumnRenamed("block", "lo").join(block.withColumnRenamed("block", "hi"), "band").where("lo <= hi and not (lo.alone and hi.alone and lo.g = hi.g)")
    tiles = staged(tiles, "tiles")
    row = lambda at, side: placed.join(tiles.where("lo < hi") if side else tiles, (placed["band"] == tiles["band"]) & (placed["block"] == tiles[at])).select(placed["band"], "lo", "hi", F.lit(side).alias("side"), "x", "c")
    rows = row("lo", 0).unionAll(row("hi", 1)).join(sets.withColumnRenamed("node", "x"), "x")
    return rows.groupBy("band", "lo", "hi").applyInArrow(_tile(threshold), "x long, y long")


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): the id, digest and node of every row of docs (no node for a null or empty text), and the
    component of every node that has a link. A node is a 64-bit hash of the text's digest."""
    node = F.xxhash64("digest").alias("node")
    rows = staged(small_batches(docs).select("doc_id", "text").mapInArrow(_sign, "doc_id long, digest string, bands array<long>"), "signatures")
    reps = staged(rows.where("digest is not null").groupBy("digest").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id")).select(node, "bands", "doc_id"), "representatives")
    member = reps.select(F.col("node").alias("x"), F.explode("bands").alias("band"))
    # leaders are the first in one order for all bands, so that few different documents lead
    order = lambda salt: F.min(F.struct(F.xxhash64("x", F.lit(salt)).alias("o"), "x"))["x"]
    buckets = staged(member.groupBy("band").agg(F.count("*").alias("m"), order(1).alias("l1"), order(2).alias("l2")).where("m > 1"), "buckets")
    member = staged(member.join(buckets, "band"), "members")
    led = member.select(F.explode(F.array_distinct(F.array("l1", "l2"))).alias("l"), "x").where("l <> x").select(F.least("l", "x").alias("x"), F.greatest("l", "x").alias("y")).distinct()
    # one row for each text: the id is part of the key, so that copies don't meet in one task
    one = reps.select("node", F.coalesce("doc_id", F.lit(-1)).alias("i")).join(member.select(F.col("x").alias("node")).distinct(), "node", "left_semi")
    sets = docs.where("text <> ''").select(F.xxhash64(F.md5(F.encode("text", "utf-8"))).alias("node"), F.coalesce("doc_id", F.lit(-1)).alias("i"), "text").join(one, ["node", "i"], "left_semi")
    sets = staged(sets.dropDuplicates(["node", "i"]).select("node", "text").mapInArrow(_shingle, "node long, sh array<long>"), "shingles")
    links = staged(_verify(staged(led, "led"), sets, threshold), "links")
    stars = staged(components(links, "x", "y"), "stars")
    # what a bucket holds besides one component
    rest = member.join(stars.withColumnRenamed("node", "x"), "x", "left").select("band", "m", "x", F.coalesce("component", "x").alias("c"))
    mixed = rest.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("band")
    rest = staged(rest.join(staged(mixed, "mixed"), "band"), "apart")
    w = W.partitionBy("band").orderBy("x")
    after = F.array(*[F.lead(F.struct(F.col("x").alias("y"), F.col("c").alias("d")), i).over(w) for i in range(1, SMALL_BUCKET)])
    small = rest.where(F.col("m") <= SMALL_BUCKET).select("x", "c", after.alias("ns")).select("x", "c", F.explode("ns").alias("n")).where("n is not null and n.d <> c").select("x", F.col("n.y").alias("y")).distinct()
    more = staged(_verify(small, sets, threshold).unionAll(_tiled(rest.where(F.col("m") > SMALL_BUCKET), sets, threshold)), "links")
    if more.limit(1).count():
        stars = components(more.unionAll(stars.where("node <> component").select(F.col("node").alias("x"), F.col("component").alias("y"))), "x", "y")
    return rows.select("doc_id", "digest", F.when(F.col("digest").isNotNull(), node).alias("node")), stars


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id, exact_id) of every row of docs (doc_id, text; other columns are ignored).

    Two texts are linked if their five-word shingles, weighted by their counts, have a Jaccard similarity of `threshold`
    or more. exact_id is the smallest doc_id with the same text, component_id the smallest one reachable over links;
    null ids are passed over unless a class has no other. Copies are joined before any comparison, so a group of copies
    costs one signature. Null and empty texts join nothing; texts without words join their copies only; repeated rows
    and texts that share an id are rows of their own. Members of a bucket are compared with two leaders, and then with
    every member that isn't in their component yet: listed in buckets of up to SMALL_BUCKET, in tiles beyond. An empty
    table gives no rows."""
    rows, stars = _classes(docs, threshold)
    exact = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("exact_id"))
    exact = staged(exact.join(stars, "node", "left").select("node", "exact_id", F.coalesce("component", "node").alias("component")), "exact")
    first = exact.groupBy("component").agg(F.min("exact_id").alias("component_id"))
    own = exact.join(first, "component").select("node", "exact_id", "component_id")
    out = rows.where("node is not null").join(own, "node").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("exact_id", "doc_id").alias("exact_id"))
    return out.unionAll(rows.where("node is null").select("doc_id", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("exact_id")))


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, that are the one of their class: the text of the smallest doc_id, of several the one
    whose digest is smallest. Rows that repeat it under the same id are one row, that of the smallest values. Null and
    empty texts and rows with a null doc_id, which can't be told apart, stay. An empty table gives no rows."""
    rows, stars = _classes(docs.where("doc_id is not null"), threshold)
    of_class = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("r"), F.count("*").alias("n")).join(stars, "node", "left")
    kept = of_class.groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("r").alias("r")).select(F.col("r.doc_id").alias("doc_id"), F.col("r.digest").alias("_kept"))
    kept = staged(kept, "kept")
    empty = F.col("doc_id").isNull() | (F.coalesce(F.length("text"), F.lit(0)) == 0)
    chosen = docs.where(~empty).withColumn("_kept", F.md5(F.encode("text", "utf-8"))).join(kept, ["doc_id", "_kept"], "left_semi").select(docs.columns)
    twice = rows.join(kept.withColumnRenamed("_kept", "digest"), ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest").count().where("count > 1").select("doc_id").distinct()
    if twice.limit(1).count():
        repeated = chosen.join(twice, "doc_id", "left_semi")
        first = repeated.withColumn("_first", F.row_number().over(W.partitionBy("doc_id", F.md5(F.encode("text", "utf-8"))).orderBy(*[F.col(f.name) for f in docs.schema if f.dataType.typeName() not in ("map", "variant")])))
        chosen = chosen.join(twice, "doc_id", "left_anti").unionAll(first.where("_first = 1").select(docs.columns))
    return chosen.unionAll(docs.where(empty))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its class, and whether it is the one of its class that stays."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "component_id", "exact_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
