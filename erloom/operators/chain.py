"""The whole chain from candidate pairs to an assignment: models, owners, vetoes, expected F0.5, siblings, additions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from erloom.sources.store import staged

from . import decide, features, models

THRESHOLD, FLOOR, SIBLING_MAX, DECOY_WEIGHT = 0.85, 0.01, 0.95, 1.887
#: Pairs that a text model scores again: the first two of a record with a probability between these.
BAND = (0.01, 0.99)
RULES = ("veto", "expected", "sibling", "additions", "rescue")
#: Stage-1 scores below this mark a pair that only later stages promoted.
PROMOTED = 0.3
# fixed values: words that an exact address leaves out of a name
ADDRESS_RULE_DROP = ("sa", "sas", "sasu", "sarl", "eurl", "sci", "snc", "gmbh", "inc", "llc", "ltd", "pvt", "private", "limited", "llp", "lp", "corp", "co", "company", "plc", "pllc", "pc", "incorporated", "corporation", "de", "du", "des", "la", "le", "les", "et", "and", "the", "of", "d", "l")


def guarded_owners(scores: DataFrame, guarded: Column | None = None) -> DataFrame:
    """(rid, s1, p): each record's likeliest entity. Where `guarded` holds, a second model's p_guard must name the same
    entity, the lower of both counts, and a record on which they disagree has 0."""
    own = features.best_of_record(scores)
    if guarded is None:
        return own
    second = features.best_of_record(scores.select("rid", "s1", F.col("p_guard").alias("p"))).select("rid", F.col("s1").alias("g"), F.col("p").alias("gp"))
    where = scores.select("rid", guarded.alias("guarded")).groupBy("rid").agg(F.bool_or("guarded").alias("guarded"))
    d = own.join(second, "rid", "left").join(where, "rid", "left")
    p = F.when(F.coalesce("guarded", F.lit(False)), F.when(F.col("s1") == F.col("g"), F.least("p", "gp")).otherwise(0.0)).otherwise(F.col("p"))
    return d.select("rid", "s1", p.alias("p"))


def sibling_rule(kept: DataFrame, below: float = SIBLING_MAX) -> DataFrame:
    """kept (rid, s1, p, fne) without the doubtful records whose house number differs where another record of the same
    source and entity has the right one. One pass: the group only has to know whether it has one."""
    group = W.partitionBy("s1", F.expr(f"rid div {features.SOURCE}"))
    right = F.coalesce(F.max(F.when(F.col("fne") == 1, 1)).over(group), F.lit(0))
    return kept.withColumn("_right", right).where(~((F.col("p") < below) & (F.coalesce("fne", F.lit(1)) == 0) & (F.col("_right") == 1))).drop("_right")


def exact_addresses(cand: DataFrame, qt: DataFrame, st: DataFrame) -> DataFrame:
    """(rid, s1): records at the numbered address of exactly one entity, not yet a candidate of it, whose name is the
    beginning of the entity's initials or has no word that the country's names know."""
    key = lambda df: df.withColumn("k", decide.address_key(F.col("address"), decide.REGION, split_suffix=False)).where(F.col("k").rlike("[0-9]"))
    said = lambda name: F.filter(F.split(name, " "), lambda w: (w != "") & ~w.isin(*ADDRESS_RULE_DROP))
    one = key(st).groupBy("country", "k").agg(F.count("*").alias("n"), F.first("eid").alias("s1"), F.first("name_full").alias("s_name")).where("n = 1").drop("n")
    known = st.select("country", F.explode(F.split("name_full", " ")).alias("w")).distinct()
    pairs = key(qt).select(F.col("eid").alias("rid"), "country", "k", said("name_full").alias("said")).join(one, ["country", "k"]).join(cand.select("rid", "s1"), ["rid", "s1"], "left_anti")
    pairs = pairs.withColumn("initials", F.array_join(F.transform(said(F.col("s_name")), lambda w: F.substring(w, 1, 1)), ""))
    seen = pairs.select("rid", "s1", "country", F.explode("said").alias("w")).join(known, ["country", "w"], "left_semi").select("rid", "s1").distinct().withColumn("seen", F.lit(True))
    only = F.get("said", F.lit(0))
    acronym = (F.size("said") == 1) & only.rlike("^[a-z]{2,4}$") & F.startswith(F.col("initials"), only)
    new = (F.size("said") > 0) & ~F.coalesce("seen", F.lit(False))
    return pairs.join(seen, ["rid", "s1"], "left").where(acronym | new).select("rid", "s1")


def families(pairs: DataFrame, replacements: DataFrame) -> DataFrame:
    """Assigned pairs (with texts, p1) and the three decoy families that each falls in: shift, replacement, promoted."""
    number = F.get(F.regexp_extract_all("q_address", F.lit(r"\b[0-9]+\b"), F.lit(0)), F.lit(0))
    whole = lambda k: F.filter(F.split(f"{k}_address", " "), lambda t: t.rlike("^[0-9]{1,9}$"))
    d = pairs.withColumns({"_n": number, "_q": F.array_except(whole("q"), whole("s")), "_s": F.array_except(whole("s"), whole("q"))})
    siblings = F.when(F.col("_n").isNull(), 0).otherwise(F.count("*").over(W.partitionBy("s1", "_n")) - 1)
    moved = F.exists("_q", lambda a: F.exists("_s", lambda b: (a.cast("int") - b.cast("int")).isin(*features.SHIFTS)))
    d = d.withColumn("shift", (siblings == 0) & moved).join(decide.by_country(replacements).withColumnRenamed("country", "q_country"), "q_country", "left")
    new = F.arrays_overlap(decide.new_words_of("q_name_full", "s_name_full"), F.coalesce("words", F.array().cast("array<string>")))
    return d.withColumns({"replacement": new, "promoted": F.col("p1") < PROMOTED}).drop("_n", "_q", "_s", "words")


def apply_changes(assigned: DataFrame, removals: DataFrame, additions: DataFrame, entities: DataFrame) -> DataFrame:
    """assigned (rid, s1) without the removals, and with the additions of known entities for records that have none, the
    smallest entity of each record. A record never has two."""
    left = assigned.select("rid", "s1").join(removals.select("rid", "s1").distinct(), ["rid", "s1"], "left_anti")
    fresh = additions.join(left.select("rid"), "rid", "left_anti").join(entities.select(F.col("eid").alias("s1")), "s1", "left_semi")
    return left.unionByName(fresh.groupBy("rid").agg(F.min("s1").alias("s1")))


def decided(scores: DataFrame, cand: DataFrame, qt: DataFrame, st: DataFrame, decoys: DataFrame, rescued: DataFrame | None = None, rules: tuple[str, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(rid, s1, origin) of every assigned record: best owner, decoy veto, expected F0.5 or threshold, sibling rule, exact
    addresses, rescue, in this order. Additions pass over records that the sibling rule has dropped; rescue doesn't."""
    floor = min(threshold, FLOOR) if "expected" in rules else threshold
    best = features.with_texts(features.best_of_record(scores).where(F.col("p") >= floor), qt, st)
    if "veto" in rules:
        words = decide.by_country(decoys).withColumnRenamed("country", "q_country")
        best = best.join(words, "q_country", "left").where(~decide.vetoed(best, words))
    first = lambda k: F.get(F.col(f"{k}_numbers"), F.lit(0))
    best = staged(best.select("rid", "s1", "p", (first("q") == first("s")).cast("int").alias("fne")), "best")
    kept = best
    if "expected" in rules:
        chosen = decide.expected_f05(best, DECOY_WEIGHT).where("keep").select("rid", "s1")
        kept = staged(best.join(chosen, ["rid", "s1"], "left_semi"), "kept")
    after = sibling_rule(kept) if "sibling" in rules else kept
    out = after.select("rid", "s1", F.lit("scored").alias("origin"))
    if "additions" in rules:
        extra = exact_addresses(cand, qt, st).join(kept.select("rid"), "rid", "left_anti").groupBy("rid").agg(F.min("s1").alias("s1"))
        out = out.unionByName(extra.select("rid", "s1", F.lit("address").alias("origin")))
    if "rescue" in rules and rescued is not None:
        out = staged(out, "assigned")
        fresh = rescued.join(out.select("rid"), "rid", "left_anti").groupBy("rid").agg(F.min("s1").alias("s1"))
        out = out.unionByName(fresh.select("rid", "s1", F.lit("rescue").alias("origin")))
    return out


def stage1(pairs: DataFrame, **how) -> DataFrame:
    """pairs with p, the first model's out-of-fold probability; folds by record."""
    return models.out_of_fold(pairs, models.STAGE1, models.halves("rid"), "p", **how)


def stage2(pairs: DataFrame, qt: DataFrame, st: DataFrame, decoys: DataFrame, replacements: DataFrame, **how) -> DataFrame:
    """pairs (with p) with p2: the second model, which also sees a pair's standing among its record's and its entity's
    pairs and how the record fits its siblings."""
    context = features.context_features(pairs.select("rid", "s1", "p", "combined"))
    odd = features.odd_features(pairs.select("rid", "s1", "p"), qt, st, decoys, replacements)
    both = staged(pairs.join(context, ["rid", "s1"]).join(odd, ["rid", "s1"], "left"), "stage2")
    return models.out_of_fold(both, models.STAGE2, models.halves("rid"), "p2", **how)


def band(scored: DataFrame) -> DataFrame:
    """Pairs of the uncertain band: the first two of a record by p2, inside BAND."""
    at = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("p2"), "s1"))
    return scored.withColumn("_at", at).where(F.col("_at") <= 2).where(F.col("p2").between(*BAND)).drop("_at")


def stacked(scored: DataFrame, qt: DataFrame, st: DataFrame, **how) -> DataFrame:
    """(rid, s1, ps) of the band: a text model's out-of-fold logit and both stages' logits under a stacker, out of fold by
    entity. An empty band, or one of a single class in a fold, has no rows: the stages' scores stand."""
    text = lambda df, k, key: df.select(F.col("eid").alias(key), F.concat("name_full", F.lit(" | "), F.coalesce("address", F.lit(""))).alias(f"{k}_text"))
    rows = band(scored).join(text(qt, "q", "rid"), "rid").join(text(st, "s", "s1"), "s1")
    rows = staged(rows.select("rid", "s1", "label", "q_text", "s_text", "address_missing", "source", "rk", models.logit("p").alias("logit_p1"), models.logit("p2").alias("logit_p2")), "band")
    seen = rows.groupBy(models.halves("s1").alias("half")).agg(F.countDistinct("label").alias("n")).collect()  # two rows
    if len(seen) < 2 or min(r.n for r in seen) < 2:
        return rows.select("rid", "s1", F.lit(None).cast("double").alias("ps")).where("false")
    ce = staged(models.out_of_fold(rows, ["q_text", "s_text"], models.halves("s1"), "ce", fit=models.fit_text, apply=models.score_text), "text")
    return models.stack(ce, ["logit_p2", "ce", "logit_p1", "address_missing", "source", "rk"], **how).select("rid", "s1", "ps")


def substituted(scored: DataFrame, stack: DataFrame, guarded: Column | None = None) -> DataFrame:
    """(rid, s1, p): the stacker's score where there is one, else the second stage's; where `guarded` holds it can only
    fall."""
    d = scored.join(stack, ["rid", "s1"], "left")
    p = F.coalesce("ps", "p2")
    return d.select("rid", "s1", (p if guarded is None else F.when(guarded, F.least("p2", p)).otherwise(p)).alias("p"))


#: Features of pairs that blocking from the registry's side brings up, and of their second model.
REVERSE1 = ["score", "nkeys", "rk", "name_jaccard", "address_jaccard", "num_common", "nums_subset", "first_num_equal", "first_num_diff", "legal_clash", *[n for n, _, _ in features.FUZZY]]
REVERSE2 = [*REVERSE1, "p", "ce", "competitor"]
REVERSE_SHARE, REVERSE_RIVAL, REVERSE_P = 0.01, 0.2, 0.6


def reverse_pairs(found: DataFrame, cand: DataFrame, scores: DataFrame, qt: DataFrame, st: DataFrame) -> DataFrame:
    """Pairs of reverse blocking (rid, s1, score, nkeys, rk) outside the candidates, with features and the highest
    probability that the record has with any other entity."""
    return _with_rivals(_reverse_features(_fresh(found, cand), qt, st), scores)


def _fresh(found: DataFrame, cand: DataFrame) -> DataFrame:
    return found.join(cand.select("rid", "s1"), ["rid", "s1"], "left_anti")


def _reverse_features(fresh: DataFrame, qt: DataFrame, st: DataFrame) -> DataFrame:
    made = features.overlap_columns() | features.number_columns() | features.legal_columns()
    d = features.with_texts(fresh, qt, st)
    text = {f"{k}_text": F.concat(F.col(f"{k}_name_full"), F.lit(" | "), F.col(f"{k}_address")) for k in "qs"}
    kept = [*fresh.columns, *[c for c in REVERSE1 if c in made], *text]
    return d.withColumns(made | text).select(*kept, features.fuzzy_column().alias("f")).select(*kept, "f.*")


def _with_rivals(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    rival = scores.groupBy("rid").agg(F.max("p").alias("competitor"))
    return pairs.join(rival, "rid", "left").fillna(0.0, ["competitor"])


def _labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.select("rid", "s1", F.lit(1).alias("label")), ["rid", "s1"], "left").fillna(0, ["label"])


def _learnable(df: DataFrame) -> bool:
    """Whether both folds by entity have both classes."""
    seen = df.groupBy(models.halves("s1").alias("half")).agg(F.countDistinct("label").alias("n")).collect()  # two rows
    return len(seen) == 2 and min(r.n for r in seen) == 2


def reverse_accepted(pairs: DataFrame, truth: DataFrame, share: float = REVERSE_SHARE, scores: Callable[[], DataFrame] | None = None) -> DataFrame:
    """(rid, s1): of reverse pairs the one of each record that two models take, both out of fold by entity: the best share by
    the first goes to a text score and the second; a record with a likely entity of its own takes none. Without both
    classes in both folds nothing is accepted.

    Only the second model and what follows it read `competitor`. Where pairs come without it, `scores` makes the forward
    scores, and is called only if there is a second model to fit."""
    rows = staged(_labelled(pairs, truth), "reverse")
    if not _learnable(rows):
        return rows.select("rid", "s1").where("false")
    one = staged(models.out_of_fold(rows, REVERSE1, models.halves("s1"), "p", rounds=20, depth=4), "reverse1")
    cut = one.agg(F.percentile_approx("p", F.lit(1 - share))).first()[0]
    top = one.where(F.col("p") >= cut)
    if not _learnable(top):
        return rows.select("rid", "s1").where("false")
    if scores:
        top = _with_rivals(top, scores())
    ce = staged(models.out_of_fold(top, ["q_text", "s_text"], models.halves("s1"), "ce", fit=models.fit_text, apply=models.score_text), "reverse_text")
    two = models.out_of_fold(ce, REVERSE2, models.halves("s1"), "p2", rounds=20, depth=3)
    at = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("p2"), "s1"))
    return two.where((F.col("competitor") < REVERSE_RIVAL) & (F.col("p2") >= REVERSE_P)).withColumn("at", at).where("at = 1").select("rid", "s1")


def reverse_additions(found: DataFrame, cand: DataFrame, scores: Callable[[], DataFrame], qt: DataFrame, st: DataFrame, truth: DataFrame, share: float = REVERSE_SHARE) -> DataFrame:
    """reverse_accepted() of all reverse_pairs(). Whether anything can be learned shows by ids and truth alone, so features
    are made and `scores` is called only where it can."""
    fresh = staged(_fresh(found, cand), "fresh")
    if not _learnable(_labelled(fresh.select("rid", "s1"), truth)):
        return fresh.select("rid", "s1").where("false")
    return reverse_accepted(_reverse_features(fresh, qt, st), truth, share, scores)


def metric(assigned: DataFrame, truth: DataFrame, entities: DataFrame, decoy_weight: float = 1.0) -> DataFrame:
    """One row (entities, f05, f05_weighted): macro F0.5 over all entities, plain and with false positives of records that
    nobody owns at their weight."""
    owner = truth.select("rid", F.col("s1").alias("owner"))
    hit = assigned.select("rid", "s1").join(owner, "rid", "left").groupBy("s1").agg(F.count("*").alias("n"), F.count_if(F.col("owner") == F.col("s1")).alias("tp"), F.count_if(F.col("owner") != F.col("s1")).alias("wrong"), F.count_if(F.col("owner").isNull()).alias("decoy"))
    n = truth.groupBy("s1").agg(F.count("*").alias("t"))
    d = entities.select(F.col("eid").alias("s1")).join(n, "s1", "left").join(hit, "s1", "left").fillna(0)
    plain = F.when((F.col("t") == 0) & (F.col("n") == 0), 1.0).when(F.col("tp") == 0, 0.0).otherwise(1.25 * F.col("tp") / (0.25 * F.col("t") + F.col("n")))
    false = F.col("wrong") + decoy_weight * F.col("decoy")
    weighted = F.when(F.col("t") == 0, F.greatest(F.lit(0.0), 1 - false)).when(F.col("tp") == 0, 0.0).otherwise(1.25 * F.col("tp") / (0.25 * F.col("t") + F.col("tp") + false))
    return d.agg(F.count("*").alias("entities"), F.round(F.avg(plain), 6).alias("f05"), F.round(F.avg(weighted), 6).alias("f05_weighted"))
