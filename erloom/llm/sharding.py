"""Sharding by jump consistent hashing.

A key's shard is computed from the key and the shard count alone, with no ring table: the key seeds a
multiplicative generator whose jumps land on ever higher shards until one passes the count. Appending a
shard moves a 1/(n+1) share of the keys, all of them into the new shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table

#: Rows of a shard that are numbered by one task, about.
SLOT_ROWS = 100_000
LEAST_BUCKETS = 64


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard in [0, shards) of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key, out = keys.astype(np.uint64), np.zeros(len(keys), dtype=np.int64)
    live, j = np.arange(len(keys)), np.zeros(len(keys), dtype=np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = j
            k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            key[live] = k
            j = ((j + 1).astype(np.float64) * (float(1 << 31) / ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
            live, j = live[j < shards], j[j < shards]
    return out


def stable_key(col: Column) -> Column:
    """60 bits of the MD5 of the key as text, the same in any engine; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown_shard): the shard of each key among `shards`, and among one more."""

    @F.pandas_udf(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType())]))
    def of(k: pd.Series) -> pd.DataFrame:
        keys = k.to_numpy()
        return pd.DataFrame({"shard": jump(keys, shards).astype("int32"), "grown_shard": jump(keys, shards + 1).astype("int32")})

    return of(key)


def shard(df: DataFrame, key: str, shards: int, payload: list[Column]) -> DataFrame:
    """(key, payload, shard, slot, grown_shard) of every row; slot numbers a shard's rows from 0 without gaps.

    Rows are numbered inside sub-buckets of a shard, dealt by key and payload, so that no task holds a whole shard or
    all rows of a hot key; sub-bucket sizes are summed into offsets (one row for each shard and sub-bucket). Rows equal
    in key and payload are interchangeable. An empty table gives no rows; extra columns are ignored; a null key is a key
    like any other. The payload, whole numbers, and the shards are computed once and written, so texts are read once."""
    names = [df.select(c).columns[0] for c in payload]
    h = stable_key(F.col(key))
    rows = df.select(F.col(key), *payload, h.alias("_h")).withColumn("_s", jump_shards(F.col("_h"), shards))
    rows = staged(rows.select(F.col(key), *names, "_h", "_s.shard", "_s.grown_shard"), "shards")
    buckets = max(LEAST_BUCKETS, -(-rows.count() // (shards * SLOT_ROWS)))
    mixed = F.col("_h")
    for name in names:
        mixed = mixed + F.coalesce(F.col(name).cast("long"), F.lit(0))
    rows = rows.withColumn("_b", F.pmod(mixed, F.lit(buckets))).drop("_h")
    at = ["shard", "_b"]
    sizes = rows.groupBy(*at).count()
    base = sizes.select(*at, (F.sum("count").over(W.partitionBy("shard").orderBy("_b")) - F.col("count")).alias("_base"))
    numbered = rows.withColumn("_rn", F.row_number().over(W.partitionBy(*at).orderBy(key, *names)) - 1)
    out = numbered.join(base, at).withColumn("slot", (F.col("_base") + F.col("_rn")).cast("long"))
    return out.select(key, *names, "shard", "slot", "grown_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39 by doc_id. Null text: size 16, CRC of the empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    payload = [(F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32")]
    out = shard(table(spark, sf_dir, "documents"), "doc_id", 40, payload)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
