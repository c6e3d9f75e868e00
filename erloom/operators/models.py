"""Pair models: staged gradient-boosted trees with early stopping and out-of-fold scores, a text scorer, a stacker over
logits, and how to keep them."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import FUZZY, RELATIVE

MISSING = -999.0
#: Features of the first stage: relational, fuzzy, relative; and those that the second stage takes over from it.
RELATIONAL = (
    "score nkeys rk top1 top2 ncand source score_ratio gap_top1 record_margin s1_n_cand s1_n_top1 score_ratio_s1 q_name_len q_address_len s_name_len s_address_len "
    "address_missing s1_address_missing name_translit name_jaccard address_jaccard name_first_equal num_common q_num_count s_num_count q_nums_unmatched nums_subset first_num_equal first_num_diff q_legal_n s_legal_n legal_same legal_clash"
).split()
STAGE1 = [*RELATIONAL, *[name for name, _, _ in FUZZY], "combined", *[f"{x}_{k}" for x in RELATIVE for k in ("gap", "rank")]]
BASE = "combined combined_gap name_token_set address_token_set name_full_ratio first_num_equal nums_subset num_common name_translit address_missing source rk score_ratio legal_clash first_num_diff".split()
CONTEXT = "p_gap_rid p_margin r_second r_n is_best s_n_best_other s_n_conf_other s_sum_other s_max_other s_n_pairs combined_gap_s1".split()
ODD = (
    "o_n5 o_n9 o_n9_x o_name_sib o_name_rel o_addr_sib o_addr_rel o_name_eq_sib o_addr_eq_sib o_d1 o_d1_cls o_shift_d8 o_shift_p12 o_shift_n12 "
    "o_q1_sib o_s1_sib o_odd_num o_qx_n o_qx_sib o_qx_unexpl o_sfx_new o_sfx_sib o_add_n o_add_unsup o_rem_n o_rem_kept o_veto o_l2"
).split()
STAGE2 = ["p", *CONTEXT, *BASE, *ODD]
#: Rounds of boosting at most; one row in VALID is held out of a fit, and rounds end where they no longer gain there.
ROUNDS, DEPTH, VALID, GAIN = 40, 5, 20, 0.005


def _ready(df: DataFrame, names: list[str]) -> DataFrame:
    """Missing values get a sentinel of their own, which trees can split off."""
    return df.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in names})


def _held(*keys: str) -> Column:
    """One row in VALID, by its keys: the same rows however they are dealt out."""
    return F.pmod(F.xxhash64(*keys), F.lit(VALID)) == 0


def halves(key: str) -> Column:
    """0 or 1 by a hash of the key: folds of records or entities, told apart by nothing else."""
    return F.pmod(F.xxhash64(key, F.lit(3)), F.lit(2))


def fit_trees(df: DataFrame, names: list[str], label: str = "label", rounds: int = ROUNDS, depth: int = DEPTH, weight: str | None = None, keys: tuple[str, ...] = ("rid", "s1")) -> PipelineModel:
    """Boosted trees with early stopping; `weight` names a column of row weights."""
    trees = GBTClassifier(labelCol=label, featuresCol="_x", maxIter=rounds, maxDepth=depth, seed=1, validationIndicatorCol="_valid", validationTol=GAIN)
    if weight:
        trees = trees.setWeightCol(weight)
    stages = [VectorAssembler(inputCols=[f"_{c}" for c in names], outputCol="_x"), trees]
    return Pipeline(stages=stages).fit(_ready(df, names).withColumn("_valid", _held(*keys)))


def class_weight(df: DataFrame, label: str = "label", name: str = "w") -> DataFrame:
    """df with a weight that gives both classes the same total; 1 where only one occurs."""
    n = df.groupBy(label).count().collect()  # two rows
    total = sum(r["count"] for r in n)
    weight = F.lit(1.0)
    for r in n:
        weight = F.when(F.col(label) == r[label], total / (len(n) * r["count"])).otherwise(weight)
    return df.withColumn(name, weight)


def _probability(out: DataFrame, name: str, drop: list[str]) -> DataFrame:
    return out.withColumn(name, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction", *drop)


def score(model: PipelineModel, df: DataFrame, names: list[str], name: str = "p") -> DataFrame:
    return _probability(model.transform(_ready(df, names)), name, [f"_{c}" for c in names])


def out_of_fold(df: DataFrame, names: list[str], fold: Column, name: str, fit=fit_trees, apply=score, **how) -> DataFrame:
    """Each half scored by the model of the other half; `fold` is 0 or 1."""
    both = [df.where(fold == k) for k in (0, 1)]
    parts = [apply(fit(both[1 - k], names, **how), both[k], names, name) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def logit(p: str | Column) -> Column:
    c = F.least(F.greatest(F.col(p) if isinstance(p, str) else p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(c / (1 - c))


def _grams(text: str) -> Column:
    """Runs of three characters of a text, with a space before and after."""
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: padded.substr(i, F.lit(3))))


def pair_grams(df: DataFrame, query: str = "q_text", entity: str = "s_text") -> DataFrame:
    """`_grams`: what both texts share and what either has alone, each run of three characters under its kind."""
    d = df.withColumns({"_q": _grams(query), "_s": _grams(entity)})
    marked = lambda kind, c: F.transform(c, lambda g: F.concat(F.lit(kind), g))
    every = F.concat(marked("=", F.array_intersect("_q", "_s")), marked("+", F.array_except("_q", "_s")), marked("-", F.array_except("_s", "_q")))
    return d.withColumn("_grams", every).drop("_q", "_s")


def fit_text(df: DataFrame, names: list[str], label: str = "label", features: int = 1 << 14) -> PipelineModel:
    """A stand-in for a cross-encoder: a linear model over the hashed runs of characters of both texts, `names`."""
    stages = [HashingTF(inputCol="_grams", outputCol="_x", numFeatures=features, binary=True), LogisticRegression(labelCol=label, featuresCol="_x", regParam=1e-3, maxIter=40)]
    return Pipeline(stages=stages).fit(pair_grams(df, *names))


def score_text(model: PipelineModel, df: DataFrame, names: list[str], name: str = "ce") -> DataFrame:
    """The text scorer's logit as `name`."""
    out = _probability(model.transform(pair_grams(df, *names)), "_p", ["_grams"])
    return out.withColumn(name, logit("_p")).drop("_p")


def stack(df: DataFrame, names: list[str], name: str = "ps", label: str = "label", fold: Column | None = None, rounds: int = 20, depth: int = 3) -> DataFrame:
    """df with out-of-fold scores of trees over `names`, folds by entity: no row is scored by a model that saw its entity."""
    fold = halves("s1") if fold is None else fold
    return out_of_fold(df, names, fold, name, label=label, rounds=rounds, depth=depth)


def save(model: PipelineModel, path: str, names: list[str], **facts) -> None:
    """The model and what belongs to it: the names of its features and any other facts."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps({"features": names, **facts}),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def precision_recall(scored: DataFrame, thresholds: list[float], label: str = "label", p: str = "p", beta: float = 0.5) -> DataFrame:
    """(threshold, tp, fp, fn, precision_, recall, f_beta) of scored pairs at each threshold, in one pass."""
    spark = scored.sparkSession
    at = spark.createDataFrame([(t,) for t in thresholds], "threshold double")
    hit = F.col(p) >= F.col("threshold")
    n = scored.select(p, label).crossJoin(F.broadcast(at)).groupBy("threshold").agg(F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp"), F.count_if(~hit & (F.col(label) == 1)).alias("fn"))
    share = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    precision, recall, b2 = share(F.col("tp"), F.col("fp")), share(F.col("tp"), F.col("fn")), beta * beta
    f = F.when(precision + recall > 0, (1 + b2) * precision * recall / (b2 * precision + recall)).otherwise(0.0)
    return n.select("threshold", "tp", "fp", "fn", F.round(precision, 6).alias("precision_"), F.round(recall, 6).alias("recall"), F.round(f, 6).alias("f_beta"))


#: Ranges of scores whose ranks are taken apart.
RANGES = 1024


def ranking(scored: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """One row (auc, average_precision, positives) of scores between 0 and 1, ties by average rank.

    Scores are counted by value and ranked inside RANGES ranges, so no task holds them all; the ranges' totals, one row
    each, give where a range begins."""
    from pyspark.sql import Window as W

    each = scored.groupBy(p).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n")).withColumn("r", F.floor(F.col(p) * RANGES))
    totals = each.groupBy("r").agg(F.sum("pos").alias("rp"), F.sum("n").alias("rn"))
    up = W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    starts = totals.select("r", F.coalesce(F.sum("rn").over(up), F.lit(0)).alias("below"), F.coalesce(F.sum("rp").over(up), F.lit(0)).alias("pos_below"))
    inside = W.partitionBy("r").orderBy(p).rowsBetween(W.unboundedPreceding, W.currentRow)
    all_ = totals.agg(F.sum("rp").alias("pos_all"), F.sum("rn").alias("n_all"))
    d = each.withColumns({"n_to": F.sum("n").over(inside), "p_to": F.sum("pos").over(inside)}).join(starts, "r").crossJoin(F.broadcast(all_))
    d = d.withColumns({"rank": F.col("below") + F.col("n_to") - F.col("n") + (F.col("n") + 1) / 2.0, "tp": F.col("pos_all") - F.col("pos_below") - F.col("p_to") + F.col("pos"), "taken": F.col("n_all") - F.col("below") - F.col("n_to") + F.col("n")})
    auc = (F.sum(F.col("pos") * F.col("rank")) - F.max("pos_all") * (F.max("pos_all") + 1) / 2.0) / (F.max("pos_all") * (F.max("n_all") - F.max("pos_all")))
    ap = F.sum(F.col("pos") * F.col("tp") / F.col("taken")) / F.max("pos_all")
    return d.agg(F.round(auc, 6).alias("auc"), F.round(ap, 6).alias("average_precision"), F.max("pos_all").cast("long").alias("positives"))
