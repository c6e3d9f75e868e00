"""From raw documents to packed training sequences in five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erloom.llm import decontam, langid, minhash, packing, secrets
from erloom.llm.common import staged, table
from erloom.llm.tokens import default_tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language stay: null and empty texts and those without a letter go, as do those of
    which no language has its share. Repeated rows are judged alike; with nothing to learn from all stay."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the smallest doc_id; of rows that repeat it one; of several texts under that id
    the one with the smallest digest. Rows with a null doc_id stay, as does every document without a partner."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go. Null and empty texts hold none; an empty benchmark removes nothing."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked and n_chars counted anew; every row stays, null and empty texts as they are."""
    out = secrets.mask_secrets(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids; a null or empty text is its end id, and equal rows are packed each."""
    return packing.pack(docs, default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("packing", packed),
]

#: Learned and hashed stages have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all rows that the one before kept. An empty table of documents gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
