"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that is learned from. A first positive-against-unlabelled model
ranks held-back halves of both; the least ratio of the unlabelled to the positive share above a threshold, with its
confidence bound, estimates the class prior. The scorer then minimises the non-negative unbiased risk: where the
estimate of the negatives' risk falls below zero, the step goes the other way, so that the model can't fit
unlabelled positives as negatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, small_batches, split_words, table
from .sample import held_out, sampled

#: Rows that are learned from, about: trusted positives and unlabelled documents.
POSITIVES, UNLABELLED = 4000, 6000
STEPS, RATE = 1500, 0.1
#: Weight decay of the scorer, and of the rankers that the prior is estimated from.
DECAY, RANKER_DECAY = 1e-5, 1e-2
BINS = 12
CUT = 0.3
STATS = ("words", "chars_per_word", "upper", "marked", "marks_only", "digits", "distinct", "commonest", "lines", "distinct_lines", "ends", "capital", "plain", "short", "other")


def _attributes(vocabulary: list[str]) -> np.ndarray:
    """Of each distinct token: length, all capitals, two or more marks, marks only, a digit, sentence end, capital first,
    plain lower case, at most two characters, not in the basic plane of letters."""
    v = pa.array(vocabulary, pa.large_string())
    n = np.asarray(pc.utf8_length(v)).astype(float)
    regex = lambda p: np.asarray(pc.match_substring_regex(v, p)).astype(float)
    cols = [n, np.asarray(pc.utf8_is_upper(v)).astype(float) * (n > 1), regex(r"[^\pL\pN\s].*[^\pL\pN\s]"), regex(r"^[^\pL\pN]+$"), regex(r"\pN"), regex(r"[.!?]$"), regex(r"^\p{Lu}"), regex(r"^\p{Ll}+$"), (n <= 2).astype(float), regex(r"[^\x{0000}-\x{024F}\x{2010}-\x{2030}]")]
    return np.stack(cols, axis=1)


def _distinct(starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each run and the count of its commonest."""
    n = len(starts) - 1
    run = np.repeat(np.arange(n), np.diff(starts))
    both = np.sort(run.astype(np.int64) * (int(codes.max()) + 1 if len(codes) else 1) + codes)
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, dtype=np.int64)
    owner = both[first] // (int(codes.max()) + 1) if len(codes) else first
    most = np.zeros(n)
    np.maximum.at(most, owner, np.diff(np.append(first, len(both))))
    return np.bincount(owner, minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """STATS of each whole text; an empty text has zeros."""
    starts, codes, vocabulary = split_words(texts)
    n = np.diff(starts)
    sums = np.zeros((len(n), 10))
    if len(codes):
        a = _attributes(vocabulary)
        total = np.concatenate([np.zeros((1, a.shape[1])), np.cumsum(a[codes], axis=0)])
        sums = total[starts[1:]] - total[starts[:-1]]
    kinds, most = _distinct(starts, codes)
    lists = pc.split_pattern(texts, "\n")
    at = np.asarray(lists.offsets).astype(np.int64)
    lines = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    line_kinds, _ = _distinct(at - at[0], np.asarray(lines.indices))
    m, k = np.maximum(n, 1), np.maximum(np.diff(at), 1)
    share = sums / m[:, None]
    cols = [np.log1p(n), share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 4], kinds / m / (1 + 0.15 * np.log1p(n)), most / m, k / m, line_kinds / k, share[:, 5], share[:, 6], share[:, 7], share[:, 8], share[:, 9]]
    return np.stack(cols, axis=1)


class Scorer:
    """An additive model: each statistic adds the weight of the bin that it falls in."""

    def __init__(self, sample: np.ndarray):
        q = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(sample[:, i], q)) for i in range(sample.shape[1])]
        self.first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])
        self.weights, self.bias, self.prior = np.zeros(self.first[-1]), 0.0, 0.5

    def bins(self, stats: np.ndarray) -> np.ndarray:
        return np.stack([self.first[i] + np.searchsorted(e, stats[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins].sum(axis=1) + self.bias

    def score(self, stats: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(self.bins(stats)))

    def minimise(self, gradient) -> None:
        """Adam; gradient(margins...) gives the step's gradient by weight and for the bias."""
        m, v = np.zeros(len(self.weights) + 1), np.zeros(len(self.weights) + 1)
        for t in range(1, STEPS + 1):
            g = gradient()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.weights -= step[:-1]
            self.bias -= step[-1]

    def pull(self, bins: np.ndarray, by_row: np.ndarray) -> np.ndarray:
        g = np.bincount(bins.reshape(-1), np.repeat(by_row, bins.shape[1]), len(self.weights))
        return np.append(g, by_row.sum())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of survival rates above a threshold, taken where its
    upper confidence bound is least."""
    cuts = np.quantile(positive, np.linspace(0, 0.95, 96))
    p = (positive[None, :] >= cuts[:, None]).mean(axis=1)
    u = (unlabelled[None, :] >= cuts[:, None]).mean(axis=1)
    slack = np.sqrt(np.log(40) / (2 * len(unlabelled))) + np.sqrt(np.log(40) / (2 * len(positive)))
    best = int(np.argmin(u / p + slack / p))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def _ranker(positive: np.ndarray, unlabelled: np.ndarray) -> Scorer:
    """Positive against unlabelled, by the logistic loss."""
    ranker = Scorer(np.concatenate([positive, unlabelled]))
    p, u = ranker.bins(positive), ranker.bins(unlabelled)

    def against() -> np.ndarray:
        g = ranker.pull(p, (_sigmoid(ranker.margin(p)) - 1) / len(p)) + ranker.pull(u, _sigmoid(ranker.margin(u)) / len(u))
        return g + np.append(RANKER_DECAY * ranker.weights, 0)

    ranker.minimise(against)
    return ranker


def train(positive: np.ndarray, unlabelled: np.ndarray) -> Scorer | None:
    """Scorer from the statistics of both samples; None if either is too small to halve."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return None
    halves = [(x[::2], x[1::2]) for x in (positive, unlabelled)]
    model = Scorer(np.concatenate([positive, unlabelled]))
    # each half is ranked by what the other half taught
    priors = []
    for k in (0, 1):
        ranker = _ranker(halves[0][k], halves[1][k])
        priors.append(estimate_prior(ranker.score(halves[0][1 - k]), ranker.score(halves[1][1 - k])))
    model.prior = pi = float(np.mean(priors))
    p, u = model.bins(positive), model.bins(unlabelled)

    model.minimise(lambda: step(model, p, u, pi))
    return model


def risk(model: Scorer, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """(positives' part, negatives' part) of the unbiased risk under the logistic loss, from the bins of both samples."""
    zp, zu = model.margin(p), model.margin(u)
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def step(model: Scorer, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the non-negative risk: that of both parts, or against the negatives' part where it is below zero."""
    zp, zu = model.margin(p), model.margin(u)
    g = model.pull(u, _sigmoid(zu) / len(zu)) - model.pull(p, prior * _sigmoid(zp) / len(zp))
    if risk(model, p, u, prior)[1] < 0:
        g = -g
    else:
        g = g + model.pull(p, prior * (_sigmoid(zp) - 1) / len(zp))
    return g + np.append(DECAY * model.weights, 0)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in chunks(batch):
            s = statistics(texts)
            yield pa.RecordBatch.from_arrays([rows.column("positive"), pa.array(list(s), pa.list_(pa.float64()))], ["positive", "stats"])


def _some(ids: DataFrame, rows: int, salt: int) -> DataFrame:
    """About `rows` of the ids, by a hash: the same ones however they are dealt out."""
    return ids.where(sampled("doc_id", rows / max(1, ids.count()), salt))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Scorer | None:
    """Learn from rows outside the held-out fold: documents that labels trusts, and documents without a label. Rows with
    a null doc_id are never learned from; an id that repeats counts once for each of its texts."""
    trusted = _some(labels.where((F.col("quality") == 1) & ~held_out()).select("doc_id").distinct(), positives, 11)
    web = _some(docs.where(~held_out()).select("doc_id"), 2 * unlabelled, 11)
    known = labels.join(F.broadcast(web), "doc_id", "left_semi").select("doc_id")  # web is a bounded sample
    web = _some(web.distinct().join(known, "doc_id", "left_anti"), unlabelled, 12)
    chosen = trusted.select("doc_id", F.lit(True).alias("positive")).unionAll(web.select("doc_id", F.lit(False).alias("positive")))
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, positive boolean")  # bounded by both samples
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "positive").mapInArrow(_measure, "positive boolean, stats array<double>").collect()
    held = sorted((bool(a), tuple(b)) for a, b in held)
    rng = np.random.default_rng(3)
    both = [np.array([b for a, b in held if a == kind]).reshape(-1, len(STATS)) for kind in (True, False)]
    return train(*(x[rng.permutation(len(x))] for x in both))


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Scorer | None = held.value
        for batch in batches:
            for rows, texts in chunks(batch):
                s = model.score(statistics(texts)) if model else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Scorer | None) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text; other columns are ignored). A null text counts as empty;
    empty texts are scored by their statistics, all zero; with nothing to learn from every score is 0.5. Equal texts
    have equal scores, repeated rows are scored once each, and an empty table gives no rows."""
    return small_batches(docs).select("doc_id", "text").mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from trusted positives and unlabelled documents; see score()."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
