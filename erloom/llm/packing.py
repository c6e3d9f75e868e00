"""Packing documents into training sequences as a cutting-stock problem.

Full stretches of a document become sequences of their own; what is left of each document is an item. The
histogram of item lengths gives a linear program over patterns (the multisets of lengths that fit one sequence);
columns are generated by a knapsack dynamic program over the dual prices until none improves, the fractional
solution is rounded down, what remains is filled greedily, and documents, ranked within their length class, are
assigned to the places of the patterns by their ranks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, small_batches, staged, table
from .tokens import default_tokenizer, encoder

LENGTH = 2048
END_ID = 1
#: Item lengths are classed up to the next multiple of this, which bounds the program by LENGTH / GRAIN rows.
GRAIN = 16
#: Rows of a class that one task ranks, about.
RANK_ROWS = 100_000


def _price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best multiset of sizes 1..capacity by the sum of duals[size - 1] (unbounded knapsack): value, counts."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    sizes = np.flatnonzero(duals > 0) + 1
    values = duals[sizes - 1]
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, c, side="right"))
        best[c], choice[c] = best[c - 1], 0
        if n:
            v = values[:n] + best[c - sizes[:n]]
            k = int(np.argmax(v))
            if v[k] > best[c] + 1e-12:
                best[c], choice[c] = v[k], sizes[k]
    counts, c = np.zeros(len(duals), dtype=np.int64), capacity
    while c > 0:
        if choice[c]:
            counts[choice[c] - 1] += 1
            c -= int(choice[c])
        else:
            c -= 1
    return float(best[capacity]), counts


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots: a driver's threaded linear algebra isn't needed for matrices this small."""
    m = len(a)
    w = np.hstack([a, np.eye(m)])
    for i in range(m):
        k = i + int(np.argmax(np.abs(w[i:, i])))
        w[[i, k]] = w[[k, i]]
        w[i] /= w[i, i]
        c = w[:, i].copy()
        c[i] = 0
        w -= np.outer(c, w[i])
    return w[:, m:]


def cutting_stock(demand: np.ndarray, capacity: int, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, repetitions): rows of counts by size 1..capacity, together covering demand exactly.

    Revised simplex with generated columns; the start has one pattern for each wanted size. The inverse of the
    basis is updated in place and computed anew now and then. Rounding leaves less than one item for each place
    of a pattern; those items go first-fit decreasing, once each. Raises if the program isn't solved in `rounds`."""
    wanted = np.flatnonzero(demand > 0)
    if not len(wanted):
        return np.zeros((0, len(demand)), dtype=np.int64), np.zeros(0, dtype=np.int64)
    m = len(wanted)
    basis = np.diag((capacity // (wanted + 1)).astype(float))
    inverse, b = np.diag(1.0 / np.diag(basis)), demand[wanted].astype(float)
    x = inverse @ b
    for k in range(rounds):
        full = np.zeros(len(demand))
        full[wanted] = inverse.sum(axis=0)  # duals: each pattern costs one sequence
        value, counts = _price(full, capacity)
        if value <= 1 + 1e-7:
            break
        column = counts[wanted].astype(float)
        d = inverse @ column
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        if k % 100 == 99:
            inverse = _inverse(basis)
        else:
            row = inverse[out] / d[out]
            inverse = inverse - np.outer(d, row)
            inverse[out] = row
        x = inverse @ b
    else:
        raise RuntimeError(f"column generation didn't end in {rounds} rounds")
    times = np.floor(np.maximum(x, 0) + 1e-9).astype(np.int64)
    patterns = np.zeros((m, len(demand)), dtype=np.int64)
    patterns[:, wanted] = np.rint(basis.T).astype(np.int64)
    order = np.argsort(-times, kind="stable")
    left, used, many = demand.astype(np.int64).copy(), [], []
    for i in order:  # a pattern never takes more than is there
        has = patterns[i] > 0
        n = min(int(times[i]), int((left[has] // patterns[i][has]).min()) if has.any() else 0)
        if n:
            left -= n * patterns[i]
            used.append(patterns[i])
            many.append(n)
    bins: list[list] = []
    for size in range(capacity, 0, -1):
        for _ in range(int(left[size - 1])):
            place = next((q for q in bins if q[0] >= size), None)
            if place is None:
                bins.append(place := [capacity, np.zeros(len(demand), dtype=np.int64)])
            place[0] -= size
            place[1][size - 1] += 1
    used += [q[1] for q in bins]
    many += [1] * len(bins)
    return np.array(used, dtype=np.int64).reshape(-1, len(demand)), np.array(many, dtype=np.int64)


def _pieces(path: str, length: int, end: int):
    """doc_id, text -> doc_id, n (ids of the document, the end id included), CRC of each piece, number of full
    pieces, length and class of the rest (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for rows, texts in chunks(batch, limit=8_000_000):
                starts, ids = coder.encode(texts)
                sums, n = [], np.diff(starts) + 1
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    own = np.append(ids[a:b], end).astype("<u4")
                    sums.append([zlib.crc32(own[i : i + length]) for i in range(0, len(own), length)])
                rest = n % length
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(n // length, pa.int64()), pa.array(rest, pa.int64()), pa.array(-(-rest // GRAIN), pa.int32())], ["doc_id", "n", "sums", "full", "rest", "class"])

    return run


def _ranked(rows: DataFrame, by: str, part: str, order: list[str], size: str) -> DataFrame:
    """rows with `before`: the sum of `size` over the rows of the same `by` that come earlier. Sub-buckets are
    summed apart and put one after the other, so no task holds all rows of a hot `by`."""
    totals = rows.groupBy(by, part).agg(F.sum(size).alias("_t"))
    base = totals.select(by, part, (F.sum("_t").over(W.partitionBy(by).orderBy(part)) - F.col("_t")).alias("_b"))
    w = W.partitionBy(by, part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("_r", F.sum(size).over(w) - F.col(size)).join(base, [by, part]).withColumn("before", F.col("_b") + F.col("_r")).drop("_r", "_b")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of docs (doc_id, text).

    A null or empty text is its end id alone; a text of any length is cut into whole sequences and one rest. Equal rows
    and rows that share an id are packed once each; of lengths that tie the order is that of a hash of id and text. An empty table gives no rows;
    other columns are ignored. The plan that reaches the executors has at most a few rows for each size class."""
    spark = docs.sparkSession
    kept = small_batches(docs).select("doc_id", "text").mapInArrow(_pieces(tokenizer, length, end), "doc_id long, n long, sums array<long>, full long, rest long, class int")
    kept = staged(kept, "lengths")
    parts = max(64, -(-kept.count() // RANK_ROWS))
    # dealt by id and text, so that rows of one id lie in all parts
    kept = kept.withColumn("part", F.pmod(F.xxhash64("doc_id", "sums"), F.lit(parts)))
    order = ["doc_id", "sums"]

    # whole sequences: numbered through all documents
    long = _ranked(kept.where("full > 0").select("doc_id", "n", "sums", "full", "part", F.lit(0).alias("one")), "one", "part", order, "full")
    whole = long.select("doc_id", F.posexplode(F.slice("sums", F.lit(1), F.col("full").cast("int"))).alias("i", "ids_crc32"), F.col("n").alias("doc_tokens"), "before").select(
        "doc_id", (F.col("i") * F.lit(length)).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("before") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = kept.where("rest > 0")
    total = kept.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]

    demand = np.zeros(length // GRAIN, dtype=np.int64)
    for size, n in items.groupBy("class").count().collect():  # at most length / GRAIN rows
        demand[size - 1] = n
    patterns, times = cutting_stock(demand, length // GRAIN)
    plan, taken, first = [], np.zeros(len(demand), dtype=np.int64), int(total)
    for row, n in zip(patterns, times, strict=True):
        place = 0
        for size in np.flatnonzero(row):
            c = int(row[size])
            plan.append((int(size) + 1, int(taken[size]), int(taken[size] + c * n), c, first, place))
            taken[size] += c * n
            place += c
        first += int(n)
    plan = spark.createDataFrame(plan, "class int, lo long, hi long, per long, base long, place int")
    ranked = _ranked(items.select("doc_id", "n", "sums", "rest", "part", "class", F.lit(1).alias("unit")), "class", "part", order, "unit")
    # a class has few runs of ranks, so its plan rows go along as one small array
    runs = plan.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "per", "base", "place"))).alias("runs"))
    run = ranked.join(F.broadcast(runs), "class").withColumn("run", F.element_at(F.filter("runs", lambda r: (r["lo"] <= F.col("before")) & (F.col("before") < r["hi"])), 1))
    k = F.col("before") - F.col("run.lo")
    placed = run.select("doc_id", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.element_at("sums", -1).alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("run.base") + F.floor(k / F.col("run.per"))).cast("long").alias("sequence_id"), (F.col("run.place") + k % F.col("run.per")).alias("place"))
    w = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = placed.withColumn("offset", (F.sum("length").over(w) - F.col("length")).cast("long")).drop("place")
    return whole.unionByName(placed)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids; see pack()."""
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
