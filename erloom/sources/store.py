"""Tables that many queries share, made once for each session and input and written to the shared folder.

Lineage ends at a written table, so a query plans and reads only what it needs of it, and a lost executor costs its own
tasks. A store belongs to the files that it was made of: where the input changes, the next query makes a new one."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_stores: dict[tuple, Store] = {}
_fallback: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder for a session whose executors are threads of one
    machine. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="erloom-"))
        found = _fallback[0]
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM is gone already; the folder is scratch space
        pass


def staged(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back; removed when the process ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/erloom-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def _mark(spark: SparkSession, path: str) -> tuple:
    """Size and time of the files at a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


class Store:
    """Tables by name, each made when it is first asked for. `makers` maps a name to a function of the store."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        from .tables import MAKERS

        self.spark, self.sf_dir, self.makers = spark, sf_dir, MAKERS
        self.frames: dict[str, DataFrame] = {}
        self._keyed: tuple[DataFrame, DataFrame, DataFrame] | None = None

    def table(self, name: str) -> DataFrame:
        if name not in self.frames:
            self.frames[name] = staged(self.makers[name](self), name)
        return self.frames[name]

    def keyed(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The hashed keys of both sides and their weights, which blocking from either side reads."""
        from erloom.operators import blocking

        if self._keyed is None:
            query, entities = (blocking.keys(self.table(name)) for name in ("qt", "st"))
            self._keyed = blocking.keyed(query, entities, self.table("st").count())
        return self._keyed

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def cte(self, name: str) -> str:
        """A common table expression that reads the table."""
        return f"{name} AS (SELECT * FROM parquet.`{self.table(name)._path}`)"


def of(spark: SparkSession, sf_dir: str) -> Store:
    key = (spark.sparkContext.applicationId, sf_dir, _mark(spark, f"{sf_dir}/part.parquet"))
    if key not in _stores:
        _stores[key] = Store(spark, sf_dir)
    return _stores[key]
