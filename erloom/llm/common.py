"""What the training-data operators share: scratch tables, connected components, word arrays."""

from __future__ import annotations

import atexit
import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erloom.sources.store import remove, scratch_dir

#: Texts handled at once inside a Python worker, in UTF-8 bytes; a longer text is handled alone. Spark itself bounds an
#: Arrow batch by spark.sql.execution.arrow.maxBytesPerBatch.
CHUNK_BYTES = 3_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch that may hold whole texts, on both sides of a worker's pipe at once.
BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """df itself. A plan takes the size of its Arrow batches from its session when it runs, which may be long after it is
    made, so the session keeps the smaller size; one that the user has set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the process ends."""
    path = f"{scratch_dir(spark)}/erloom-{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def staged(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there,
    and a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove the tables of staged frames that nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, df._scratch)


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, component) for each node that
    has an edge to another node; component is the smallest node reachable.

    Alternating large-star and small-star contraction until every node hangs on one other. Minima are written
    before they are joined, so both join sides are plain exchanges that adaptive execution can split at a hot node;
    the tables of a round are removed after the next. Self-loops and null ends are ignored; no edges give an empty
    result; equal edges count once."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = staged(e.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct(), "edges")
    for _ in range(rounds):
        ends = e.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select(F.col("lo").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.agg(F.coalesce(F.count_if((F.col("up") > 1) | (F.col("up") * F.col("down") > 0)), F.lit(0))).first()[0]:
            break
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        large = staged(large, "large")
        low2 = staged(large.groupBy("hi").agg(F.min("lo").alias("m")), "low")
        small = large.join(low2, "hi").select("m", F.explode(F.array("lo", "hi")).alias("v")).where("v > m")
        old, e = e, staged(small.select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct(), "edges")
        release(old, low, large, low2)
    else:
        raise RuntimeError("components did not settle")
    star = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return star.unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _give_back() -> None:
    """Return memory that a batch has left free to the system: a worker lives on between stages, beside the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES):
    """Slices of a batch with about `limit` bytes of text each; null texts count as empty."""
    col = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1, offset=8 * col.offset)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at), col.slice(at, to - at)
        at = to
    _give_back()


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """White-space tokens of each text: (start of each text's tokens with one end more, code of each token,
    distinct tokens by code). An empty text may yield the empty token."""
    lists = pc.utf8_split_whitespace(texts)
    starts = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(starts[0], starts[-1] - starts[0])
    coded = flat.dictionary_encode()
    return starts - starts[0], np.asarray(coded.indices), coded.dictionary.to_pylist()


def take_ragged(codes: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate values[starts[c]:starts[c + 1]] over the codes; also each code's length."""
    n = (starts[1:] - starts[:-1])[codes]
    total = int(n.sum())
    first = np.cumsum(n) - n
    return values[np.arange(total, dtype=np.int64) + np.repeat(starts[:-1][codes] - first, n)], n


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: the splitmix64 finalizer
GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mixing of unsigned numbers (splitmix64's finalizer after adding a seed)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * GOLDEN + GOLDEN) & 0xFFFFFFFFFFFFFFFF)
        z ^= z >> np.uint64(30)
        z *= _M1
        z ^= z >> np.uint64(27)
        z *= _M2
        z ^= z >> np.uint64(31)
    return z
