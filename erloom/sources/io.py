"""Sources and sinks: tab-separated text without quoting, Parquet, result files, change sets, word lists, catalogs."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "entity_id string, business_name string, business_address string, country string"
_PLAIN = {"sep": "\t", "header": True, "quote": "", "escape": ""}


def read_tsv(spark: SparkSession, *paths: str, schema: str = RAW) -> DataFrame:
    """Header, no quoting, no escapes, every column a string unless the schema says otherwise; files or patterns."""
    return spark.read.options(**_PLAIN).schema(schema).csv(list(paths))


def write_tsv(df: DataFrame, path: str, *order: str) -> None:
    """Sorted text without quoting: files that follow one another in order, each sorted by its own task. concatenate()
    makes one of them."""
    df.orderBy(*order).write.options(**_PLAIN, emptyValue="").csv(path)


def concatenate(spark: SparkSession, path: str, out: str) -> int:
    """The files of write_tsv as one file with one header, streamed by blocks through the file system's own client; returns
    their number. Files without rows are passed over."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(out)
    fs = folder.getFileSystem(conf)
    parts = sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda p: p.getName())
    stream = target.getFileSystem(conf).create(target, True)
    try:
        for i, part in enumerate(parts):
            source = fs.open(part)
            try:
                if i:  # the header stands once
                    while source.read() not in (10, -1):
                        pass
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 20, False)
            finally:
                source.close()
    finally:
        stream.close()
    return len(parts)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """One table from several files, folders or patterns."""
    return spark.read.parquet(*paths)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)


def with_place(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """df with a row number from 0 by an explicit order that leaves no ties: the same in every run, unlike the place of a
    row in a file. Ranges are ordered by their tasks, and their sizes, one row a range, give where each begins."""
    from pyspark.sql import Window as W

    ordered = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    from .store import staged

    ordered = staged(ordered, "placed")
    sizes = ordered.groupBy("_part").count()
    starts = sizes.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_start"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ordered.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def in_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """f over the Arrow batches of every partition; what a batch may weigh is Spark's own setting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(f, batches)

    return df.mapInArrow(run, schema)


def register(spark: SparkSession, name: str, table: pa.Table) -> DataFrame:
    """An Arrow table in memory as a view."""
    df = spark.createDataFrame(table)
    df.createOrReplaceTempView(name)
    return df


def attach(spark: SparkSession, folder: str, prefix: str, *names: str) -> list[str]:
    """Views prefix_name over the Parquet tables of another folder, to be read only; returns the views."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(f"{prefix}_{name}")
    return [f"{prefix}_{name}" for name in names]


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the catalog, replacing one of that name."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def peek(df: DataFrame, rows: int = 5) -> tuple[list[tuple[str, str]], int, list]:
    """(names and types, number of rows, the first rows by all sortable columns)."""
    order = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    return df.dtypes, df.count(), df.orderBy(*order).limit(rows).collect()


def write_changes(changes: DataFrame, path: str) -> None:
    """A change set: pairs (rid, s1), and the rule of each where there is one."""
    write_parquet(changes.select("rid", "s1", *(["rule"] if "rule" in changes.columns else [])), path)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """A change set with a rule for every pair, empty where none was kept."""
    d = spark.read.parquet(path)
    return d if "rule" in d.columns else d.withColumn("rule", F.lit(""))


def package(folder: str, names: list[str], out: str) -> list[str]:
    """A zip file of the named files of a local folder, in this order; one that is missing is an error before any is
    written. Returns the names."""
    missing = [n for n in names if not (Path(folder) / n).is_file()]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.write(Path(folder) / n, n)
    return names


def with_ids(raw: DataFrame) -> DataFrame:
    """Numeric id: source times 10^10 plus the number; missing addresses marked."""
    number = F.substring("entity_id", 2, 1).cast("long") * 10_000_000_000 + F.substring(F.col("entity_id"), 4, 20).cast("long")
    return raw.withColumns({"eid": number, "address_missing": F.lower(F.trim(F.coalesce("business_address", F.lit("")))).isin("", "none", "null", "nan")})


def read_truth(raw: DataFrame) -> DataFrame:
    """(source1_entity_id, matched) for each id of the comma lists; empty lists give no rows."""
    each = raw.select("source1_entity_id", F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ",")).alias("m"))
    return each.select("source1_entity_id", F.trim("m").alias("matched")).where("matched <> ''")


def read_words(path: str) -> dict[str, list[str]]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_words(words: dict[str, list[str]], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(words, f, ensure_ascii=False, indent=1, sort_keys=True)
