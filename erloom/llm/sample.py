"""Bounded labelled samples and the fold rule of the learned operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(key: Column | str = "doc_id") -> Column:
    """True for the fold that is never learned from: CRC-32 of the key as text, modulo 5, is 0. A null key is held out."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "utf-8")) % FOLDS == 0, F.lit(True))


def sampled(key: str, rate: float, salt: int) -> Column:
    """True for about `rate` of the keys: those whose hash is below that share of 63 bits. The same keys wherever they lie."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 1) < F.lit(min(int(rate * 2.0**63), 2**63 - 1))


def bounded(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """About per_label rows of each label, picked by a hash of doc_id.

    Rates come from counts over all rows, one for each label; rows are then kept one by one, with no shuffle of texts."""
    keep = F.lit(False)
    for value, n in rows.groupBy(label).count().orderBy(label).collect():
        keep = keep | ((F.col(label) == value) & sampled("doc_id", per_label / n, 7))
    return rows.where(keep)
