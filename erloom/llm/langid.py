"""Language identification by a linear-chain conditional random field over words.

Every word has affix, character n-gram and lexicon features; a weight for each feature and language and a learned
matrix of transitions between languages score a labelling, and forward-backward gives each word's probabilities,
so text that switches languages is labelled word by word. A document's language is the one with most expected
words. Training sequences are stretches of documents of one language, half of them spliced from two languages, so
that switches are seen."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, chunks, small_batches, split_words, table
from .sample import bounded, held_out

UNKNOWN = "und"
#: Documents of each language that are learned from, about, whole.
SAMPLE_DOCS = 200
STRETCH = 24
BUCKETS = 1 << 15
#: Words of a lexicon for each language: those that are at least so often and so purely its own.
LEXICON, PURITY, LEAST_SEEN = 3000, 0.9, 3
EPOCHS, RATE, DECAY = 5, 0.5, 1e-4
#: A sequence of more steps than LONG is run through in blocks side by side, with messages from block to block; shorter
#: ones go together, so many that their steps fill CELLS.
LONG, BLOCK, CELLS = 4096, 256, 250_000
#: Words whose scores a worker remembers; at this many it begins anew.
REMEMBERED = 100_000
#: Potentials are this share of the greatest of their step at least, so that no message vanishes in single precision.
FLOOR = 1e-12
#: A filtering stage rejects documents without letters and those of which no language has this share.
SURE = 0.4


def _letters(word: str) -> str:
    """A token's letters in lower case, marks around and inside it dropped."""
    word = word.strip(string.punctuation).lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


class Features:
    """Hashed features of distinct words in lower case, by arrays: an n-gram of 2 and of 3 characters at each place
    of `<word>`, which include the affixes of 1 and 2 letters, and for each word the affixes of 3 letters, the word
    itself if it is short, and its lexicon. The last bucket means none and keeps the weight 0."""

    def __init__(self, words: list[str], lexicon: dict[str, int], labels: int):
        self.none = BUCKETS + labels
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        cp = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(n)])
        left = np.repeat(self.starts[1:], n) - np.arange(len(cp))  # characters from each place to the end
        with np.errstate(over="ignore"):
            grams = {1: cp * np.uint64(GOLDEN)}
            for k in (2, 3, 4):
                grams[k] = np.zeros_like(cp)
                grams[k][: max(0, len(cp) - k + 1)] = (grams[k - 1][: max(0, len(cp) - k + 1)] ^ cp[k - 1 :]) * np.uint64(0xD6E8FEB86659FD93)
            place = lambda g, kind: ((g ^ (g >> np.uint64(29))) * np.uint64(GOLDEN + 2 * kind) >> np.uint64(40)).astype(np.int64) % BUCKETS
            self.places = np.stack([np.where(left >= 2, place(grams[2], 1), self.none), np.where(left >= 3, place(grams[3], 2), self.none)], axis=1)
            first, long = self.starts[:-1], n >= 5
            last = np.maximum(self.starts[1:] - 4, 0)
            short = np.where(n == 3, grams[3][first], grams[4][first]) * np.uint64(3)
        own = np.fromiter((BUCKETS + lexicon.get(w, labels) for w in words), dtype=np.int64, count=len(words))
        self.words = np.stack([np.where(long, place(grams[4][first], 3), self.none), np.where(long, place(grams[4][last], 4), self.none), np.where(n <= 4, place(short, 5), self.none), own], axis=1)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros((0, weights.shape[1]), dtype=weights.dtype)
        return np.add.reduceat(weights[self.places[:, 0]] + weights[self.places[:, 1]], self.starts[:-1], axis=0) + weights[self.words].sum(axis=1)


def _potentials(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.maximum(np.exp(emit - emit.max(axis=-1, keepdims=True)), FLOOR)
    return e, np.maximum(np.exp(trans - trans.max()), FLOOR).astype(emit.dtype)


def forward_backward(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray, switches: bool = True, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of (sequences, steps, labels) scores, and the expected transitions summed over all sequences.

    Sequences end at their lengths; steps beyond have marginals of 0. Without `switches` the transitions aren't summed.
    `before` and `after` (sequences, labels) are messages from what precedes and follows a sequence."""
    s, t, k = emit.shape
    e, m = _potentials(emit, trans)
    live = np.arange(t)[None, :] < lengths[:, None]
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] if before is None else e[:, 0] * before
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ m) * e[:, i]
        alpha[:, i] = a / a.sum(axis=1, keepdims=True)
    last = np.ones((s, k), dtype=e.dtype) if after is None else after.astype(e.dtype)
    beta[:, t - 1] = last
    for i in range(t - 2, -1, -1):
        b = (beta[:, i + 1] * e[:, i + 1]) @ m.T
        b /= b.sum(axis=1, keepdims=True)
        beta[:, i] = np.where(live[:, i + 1, None], b, last)
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    if t > 1 and switches:
        q = alpha[:, :-1, :, None] * m * (e * beta)[:, 1:, None, :]
        q /= q.sum(axis=(2, 3), keepdims=True)
        pairs = (q * live[:, 1:, None, None]).sum(axis=(0, 1))
    return p * live[:, :, None], pairs


def long_marginals(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Marginals (steps, labels) of one long sequence of scores, the same as in one run of forward_backward.

    All blocks are run through side by side: each block's product of potentials carries a message over it, so the
    messages at its two ends are known before the steps inside are."""
    t, k = emit.shape
    blocks = -(-t // BLOCK)
    grid = np.zeros((blocks * BLOCK, k), dtype=emit.dtype)
    grid[:t] = emit
    grid = grid.reshape(blocks, BLOCK, k)
    e, m = _potentials(grid, trans)
    over = np.repeat(np.eye(k, dtype=emit.dtype)[None], blocks, axis=0)
    for i in range(BLOCK):
        over = (over @ m) * e[:, i, None, :]
        over /= over.sum(axis=(1, 2), keepdims=True)
    before, after = np.ones((blocks, k), dtype=emit.dtype), np.ones((blocks, k), dtype=emit.dtype)
    at = e[0, 0]
    for i in range(1, BLOCK):  # the first block begins with no transition
        at = (at / at.sum() @ m) * e[0, i]
    for b in range(1, blocks):
        at = at / at.sum()
        before[b] = at @ m
        at = at @ over[b]
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = t - (blocks - 1) * BLOCK
    at = np.ones(k, dtype=emit.dtype)
    for i in range(lengths[-1] - 1, -1, -1):
        at = m @ (e[-1, i] * at)
        at /= at.sum()
    for b in range(blocks - 2, -1, -1):
        after[b] = at
        at = over[b] @ at
        at /= at.sum()
    p, _ = forward_backward(grid, trans, lengths, switches=False, before=before, after=after)
    return p.reshape(-1, k)[:t]


class Model:
    def __init__(self, labels: list[str], lexicon: dict[str, int], weights: np.ndarray, trans: np.ndarray):
        self.labels, self.lexicon, self.weights, self.trans = labels, lexicon, weights, trans
        self.known: dict[str, int] = {}

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words in lower case; words seen before are remembered."""
        if not self.known or len(self.known) > REMEMBERED:
            self.known, self.table = {"": 0}, np.zeros((1, len(self.labels)), dtype=np.float32)
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))
            self.table = np.concatenate([self.table, Features(some, self.lexicon, len(self.labels)).scores(self.weights).astype(np.float32)])
        return self.table[np.fromiter((self.known[w] for w in words), dtype=np.int64, count=len(words))]

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(label code or -1, score, expected words by label) of each text; words without letters are passed over."""
        starts, codes, vocabulary = split_words(texts)
        words = [_letters(w) for w in vocabulary]
        place = {w: i for i, w in enumerate(dict.fromkeys(words))}
        emit = self.emissions(list(place))
        to = np.fromiter((place[w] for w in words), dtype=np.int64, count=len(words))
        has = np.fromiter((bool(w) for w in words), dtype=bool, count=len(words))
        keep = has[codes] if len(codes) else np.zeros(0, dtype=bool)
        ends = np.concatenate([[0], np.cumsum(keep)])[starts]
        word = to[codes[keep]]
        n = np.diff(ends)
        sums = np.zeros((len(n), len(self.labels)))
        for d in np.flatnonzero(n > LONG):
            sums[d] = long_marginals(emit[word[ends[d] : ends[d + 1]]], self.trans).sum(axis=0)
        # the others, of like lengths together
        short = np.flatnonzero((n > 0) & (n <= LONG))
        short = short[np.argsort(-n[short], kind="stable")]
        while len(short):
            own, short = np.split(short, [max(1, CELLS // int(n[short[0]]))])
            grid = np.minimum(ends[own][:, None] + np.arange(n[own].max())[None, :], len(word) - 1)
            p, _ = forward_backward(emit[word[grid]], self.trans, n[own], switches=False)
            sums[own] = p.sum(axis=1)
        best = np.where(n > 0, sums.argmax(axis=1), -1)
        return best, np.where(n > 0, sums.max(axis=1) / np.maximum(n, 1), 0.0), sums


def train(rows: list[tuple[int, str, str]]) -> Model | None:
    """Model from (doc_id, text, language); None if no row has a word. Stochastic gradient (AdaGrad) on the
    log-likelihood of whole label sequences."""
    docs: list[tuple[str, list[str]]] = []
    for _, text, lang in sorted(rows):
        words = [w for w in map(_letters, (text or "").split()) if w]
        if words:
            docs.append((lang, words))
    if not docs:
        return None
    labels = sorted({d[0] for d in docs})
    code = {x: i for i, x in enumerate(labels)}
    seen: dict[str, np.ndarray] = {}
    for lang, words in docs:
        for w in words:
            seen.setdefault(w, np.zeros(len(labels)))[code[lang]] += 1
    lexicon: dict[str, int] = {}
    for i in range(len(labels)):
        own = sorted((w for w, c in seen.items() if c[i] >= LEAST_SEEN and c[i] >= PURITY * c.sum()), key=lambda w: (-seen[w][i], w))[:LEXICON]
        lexicon |= {w: i for w in own}
    vocabulary = {w: i for i, w in enumerate(seen)}
    feats = Features(list(vocabulary), lexicon, len(labels))
    rng = np.random.default_rng(1)
    parts = [(code[lang], np.array([vocabulary[w] for w in words[i : i + STRETCH]])) for lang, words in docs for i in range(0, len(words), STRETCH)]
    sequences = []
    for i in rng.permutation(len(parts)):
        x, y = parts[i][1], np.full(len(parts[i][1]), parts[i][0])
        if rng.random() < 0.5:
            j = int(rng.integers(len(parts)))
            x, y = np.concatenate([x, parts[j][1]]), np.concatenate([y, np.full(len(parts[j][1]), parts[j][0])])
        sequences.append((x, y))
    k = len(labels)
    weights, trans = np.zeros((BUCKETS + k + 1, k)), np.zeros((k, k))
    g_w, g_t = np.full_like(weights, 1e-8), np.full_like(trans, 1e-8)
    sizes = np.diff(feats.starts)
    for _ in range(EPOCHS):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), 64):
            own = [sequences[i] for i in order[at : at + 64]]
            n = np.array([len(x) for x, _ in own])
            words, inverse = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True)
            ends = np.concatenate([[0], np.cumsum(sizes[words])])
            at_place = np.arange(ends[-1]) + np.repeat(feats.starts[words] - ends[:-1], sizes[words])
            emit_w = np.add.reduceat(weights[feats.places[at_place]].sum(axis=1), ends[:-1], axis=0) + weights[feats.words[words]].sum(axis=1)
            grid, label = np.zeros((len(own), n.max()), dtype=np.int64), np.zeros((len(own), n.max()), dtype=np.int64)
            live = np.arange(n.max())[None, :] < n[:, None]
            grid[live], label[live] = inverse, np.concatenate([y for _, y in own])
            p, pairs = forward_backward(emit_w[grid], trans, n)
            truth = np.zeros_like(p)
            np.put_along_axis(truth, label[:, :, None], 1.0, axis=2)
            error = (truth - p)[live]
            by_word = np.zeros((len(words), k))
            np.add.at(by_word, inverse, error)
            gold = np.zeros((k, k))
            np.add.at(gold, (label[:, :-1][live[:, 1:]], label[:, 1:][live[:, 1:]]), 1.0)
            index = np.concatenate([feats.places[at_place].T.reshape(-1), feats.words[words].T.reshape(-1)])
            spread = np.repeat(by_word, sizes[words], axis=0)
            unique, back = np.unique(index, return_inverse=True)
            step = np.stack([np.bincount(back, np.concatenate([spread[:, i], spread[:, i], np.tile(by_word[:, i], 4)]), len(unique)) for i in range(k)], axis=1)
            step[unique == feats.none] = 0
            step = step / len(own) - DECAY * weights[unique]
            g_w[unique] += step**2
            weights[unique] += RATE * step / np.sqrt(g_w[unique])
            move = (gold - pairs) / len(own) - DECAY * trans
            g_t += move**2
            trans += RATE * move / np.sqrt(g_t)
    return Model(labels, lexicon, weights.astype(np.float32), trans)


def fit(docs: DataFrame, per_label: int = SAMPLE_DOCS) -> Model | None:
    """Learn from the text and non-null lang of the rows outside the held-out fold."""
    rows = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return train([tuple(r) for r in bounded(rows, "lang", per_label).collect()])


_SCHEMA = "doc_id long, lang_pred string, score double"


def _predict(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = held.value
        for batch in batches:
            for rows, texts in chunks(batch):
                if model is None:
                    pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    best, score, _ = model.predict(texts)
                    pred = [model.labels[b] if b >= 0 else UNKNOWN for b in best.tolist()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs (doc_id, text; other columns are ignored); score is the
    expected share of words in lang_pred, of languages that tie the first by name. A text that is null or has no letter
    is `und` with score 0, as is every text if there was nothing to learn from. Repeated rows are scored once each, a
    text of any length is one sequence, and an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return small_batches(docs).select("doc_id", "text").mapInArrow(_predict(held), _SCHEMA)


def _keep(held, sure: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = held.value
        for batch in batches:
            for rows, texts in chunks(batch):
                if model is None:
                    yield rows
                    continue
                best, score, _ = model.predict(texts)
                yield rows.filter(pa.array((best >= 0) & (score >= sure)))

    return run


def keep_identified(docs: DataFrame, model: Model | None, sure: float = SURE) -> DataFrame:
    """The rows of docs, all columns, whose language is identified; all of them if there was nothing to learn from.
    Null and empty texts and those without a letter go; repeated rows are judged once each, alike."""
    return small_batches(docs).mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model), sure), docs.schema)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from a bounded sample outside the held-out fold; see identify()."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
