"""What the shared tables of a store are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erloom.operators import blocking, chain, decide, features, rescue
from erloom.plans.dialect import Spark

from .fixtures import registry
from .store import staged

#: The fixture has few records of each class, so its word lists ask for fewer than the operators do by themselves.
LEAST = 2


def _fixture(name: str):
    def make(store) -> DataFrame:
        return store.spark.sql(f"WITH {registry(Spark(store.sf_dir))}\nSELECT * FROM {name}")

    return make


def _first(store) -> DataFrame:
    return decide.first_pairs(store.table("cand"), store.table("truth"), store.table("qt"), store.table("st"))


def _pairs(store) -> DataFrame:
    """All features of the first stage, and whether the pair is true."""
    cand, qt, st = (store.table(t) for t in ("cand", "qt", "st"))
    fuzzy = staged(features.fuzzy_features(cand, qt, st), "fuzzy")  # read twice
    label = store.table("truth").select("rid", "s1", F.lit(1).alias("label"))
    d = features.pair_features(cand, qt, st).join(fuzzy, ["rid", "s1"]).join(features.relative_features(fuzzy), ["rid", "s1"]).join(label, ["rid", "s1"], "left")
    return d.fillna(0, ["label"])


def _final(store) -> DataFrame:
    return chain.substituted(store.table("stage2"), store.table("stack"))


def _rescue(store) -> DataFrame:
    """Second-chance pairs of the records that the final scores leave without a sure owner."""
    sure = features.best_of_record(store.table("final")).where(F.col("p") >= chain.THRESHOLD).select(F.col("rid").alias("eid"))
    return rescue.selected(store.table("qt").join(sure, "eid", "left_anti"), store.table("st"), store.table("cand"))


MAKERS = {name: _fixture(name) for name in ("base", "s1", "q", "truth")}
MAKERS |= {
    "st": lambda store: features.tokens(blocking.spread(store.table("s1"))),
    "qt": lambda store: features.tokens(blocking.spread(store.table("q"))),
    "cand": lambda store: blocking.ranked(*store.keyed()),
    "pairs": _pairs,
    "decoys": lambda store: decide.decoy_words(_first(store), LEAST),
    "replacements": lambda store: decide.replacement_words(_first(store), store.table("decoys"), LEAST),
    "stage1": lambda store: chain.stage1(store.table("pairs")),
    "stage2": lambda store: chain.stage2(store.table("stage1"), store.table("qt"), store.table("st"), decide.by_country(store.table("decoys")), decide.by_country(store.table("replacements"))),
    "stack": lambda store: chain.stacked(store.table("stage2"), store.table("qt"), store.table("st")),
    "final": _final,
    "rescue": _rescue,
}
