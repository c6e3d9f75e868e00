"""Rules of one country's records beside the models: proposals for records without an owner, a review of owners and
proposals, a filter between two runs, gates, and second-chance additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import chain, decide, features

# fixed values: words that rules treat as noise, and the classes that count as the same address
ADD_NOISE = ("fils", "cie", "associes", "services", "service", "compagnie", "frs", "freres", "st", "societe", "centre", "partners")
DUAL_WORDS = ("groupe", "france", "developpement")
KEEP_NOISE = ("fils", "cie", "groupe", "services", "developpement", "associes", "france", "frs", "freres", "st")
SAME_ADDRESS = ("same", "region", "typo", "subset", "bister")
#: Rules in the order of their claim.
PRIORITY = ("A3", "A3b", "R5", "A5", "N1", "A1", "A2", "N2")
SURE, HALF, RARE_DF, TYPE_LEAST = 0.85, 0.5, 1000, 150


def _words(c: str) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != "")


def _within(words: Column, known: tuple[str, ...]) -> Column:
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*known))


def twins(st: DataFrame) -> DataFrame:
    """(s1): entities of one core name and street that stand at several house numbers."""
    street = F.array_join(F.array_sort(F.filter(F.split(F.regexp_replace("address", decide.REGION, " "), " "), lambda w: (w != "") & (w != "ndeg") & ~w.rlike("^[0-9]+$") & ~w.isin("bis", "ter"))), " ")
    d = st.select("eid", "name_core", street.alias("street"), F.regexp_extract("address", r"\b([0-9]+)\b", 1).alias("n")).where("street <> ''")
    many = d.groupBy("name_core", "street").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where("lo <> hi")
    return d.join(many, ["name_core", "street"], "left_semi").select(F.col("eid").alias("s1"))


def proposals(qt: DataFrame, st: DataFrame, scores: DataFrame, assigned: DataFrame, cand: DataFrame, rare_df: int = RARE_DF) -> DataFrame:
    """(rid, s1, rule): for each record without an owner at most one proposal, by the rule of highest claim.

    scores are (rid, s1, p, p_guard). A rule looks at the record's likeliest entity, how name and address differ, whether
    both models name it, and whether other entities share its address."""
    best = features.best_of_record(scores).join(features.best_of_record(scores.select("rid", "s1", F.col("p_guard").alias("p"))).select("rid", F.col("s1").alias("g_s1"), F.col("p").alias("g_p")), "rid", "left")
    free = best.join(assigned.select("rid"), "rid", "left_anti")
    d = features.with_texts(free, qt, st).withColumns({"n": decide.proposal_name("q_name_full", "s_name_full"), "a": decide.proposal_address("q_address", "s_address")})
    at = st.withColumn("k", decide.address_key(F.col("address"), decide.REGION, split_suffix=False))
    at = at.select(F.col("eid").alias("s1"), "k").join(at.groupBy("k").agg(F.count("*").alias("n_at")), "k").select("s1", "n_at")
    d = d.join(at, "s1", "left").join(twins(st).withColumn("twin", F.lit(True)), "s1", "left").fillna(False, ["twin"])
    df = st.select(F.explode(F.array_distinct(F.split("name_full", " "))).alias("w")).groupBy("w").count()
    lost = d.select("rid", F.explode(_words("n.removed")).alias("w")).join(df, "w", "left").groupBy("rid").agg(F.min(F.coalesce("count", F.lit(0))).alias("least_df"))
    d = d.join(lost, "rid", "left").withColumns({"least_df": F.coalesce("least_df", F.lit(99_999)), "nc": F.col("n.name_class"), "ac": F.col("a.address_class"), "delta": F.col("a.delta"), "added": _words("n.added")})
    agree, same = F.col("s1") == F.col("g_s1"), F.col("ac").isin(*SAME_ADDRESS)
    step = F.col("delta").isin(*decide.DELTAS)
    changed = agree & same & F.col("nc").isin("add", "swap") & (F.col("least_df") >= rare_df)
    rule = (
        F.when(agree & (F.col("p") >= SURE) & (F.col("g_p") < SURE) & F.col("nc").isin("legal", "order", "rm", "typo", "spaceless", "same") & same, "A3")
        .when((F.col("nc") == "acronym") & same & (F.col("n_at") == 1), "A5")
        .when(agree & F.col("nc").isin("same", "order", "typo", "spaceless") & (F.col("ac") == "num_change") & ~F.col("twin") & ((F.col("delta") < 0) | ~step), "N1")
        .when(agree & (F.col("nc") == "legal") & (F.col("ac") == "num_change") & ~F.col("twin") & (F.col("delta") < 0) & F.abs("delta").isin(*decide.DELTAS), "N2")
        .when(changed & _within(F.col("added"), ADD_NOISE), "A1")
        .when(changed & _within(F.col("added"), (*ADD_NOISE, *DUAL_WORDS)), "A2")
        .when(agree & (F.col("p") >= HALF) & (F.col("p") < SURE) & same & F.col("nc").isin("same", "legal", "order", "typo", "spaceless", "rm") & (F.col("n_at") == 1), "A3b")
    )
    found = d.select("rid", "s1", rule.alias("rule")).where("rule is not null")
    exact = chain.exact_addresses(cand.where("false"), qt, st).join(assigned.select("rid"), "rid", "left_anti").join(cand.select("rid", "s1"), ["rid", "s1"], "left_semi")
    found = found.unionByName(exact.select("rid", "s1", F.lit("R5").alias("rule")))
    claim = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("rule"))
    return found.groupBy("rid").agg(F.min_by(F.struct("s1", "rule"), F.struct(claim, "s1")).alias("r")).select("rid", "r.s1", "r.rule")


def reviewed(qt: DataFrame, st: DataFrame, scores: DataFrame, assigned: DataFrame, proposed: DataFrame) -> DataFrame:
    """Review classes of assigned pairs, of each record's first pair (an assigned one, or the likeliest) and of proposals
    that add noise words; `near` is the address class in four groups."""
    own = assigned.select("rid", "s1", F.lit(True).alias("own"))
    at = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("own"), F.desc("p"), "s1"))
    d = scores.select("rid", "s1", "p").join(own, ["rid", "s1"], "left").fillna(False, ["own"]).withColumn("top", at == 1)
    noise = proposed.where(F.col("rule").isin("A1", "A2")).select("rid", "s1", F.lit(True).alias("noise"))
    d = d.join(noise, ["rid", "s1"], "left").where(F.col("top") | F.col("own") | F.col("noise")).drop("noise")
    near = F.when(F.col("address_class").isin("same", "same_ns", "same_num_wtypo"), "same").when(F.col("address_class").isin("numchg1", "numchg1_wtypo"), "numchg1").otherwise(F.col("address_class"))
    return decide.reviewed(features.with_texts(d, qt, st)).withColumn("near", near)


def removals(review: DataFrame, raw: DataFrame | None = None, least: int = TYPE_LEAST) -> DataFrame:
    """(rid, s1, rule): owners whose one changed word is a type of business, as pairs at a shifted number show, or `compagnie`
    for anything but `cie`; and, with raw lower-case names (eid, name), those that say `france` more often than the entity."""
    types = review.where(F.col("top") & (F.col("near") == "numchg1") & (F.col("name_class") == "swap1") & F.col("added").rlike("^[a-z]{3,}$") & ~F.col("added").isin(*KEEP_NOISE, "cb", "compagnie"))
    types = types.groupBy("added").count().where(F.col("count") >= least).select("added")
    swapped = review.where(F.col("top") & F.col("own") & (F.col("near") == "same") & (F.col("name_class") == "swap1"))
    out = swapped.join(types, "added", "left_semi").select("rid", "s1", F.lit("R1_typeswap").alias("rule"))
    out = out.unionByName(swapped.where((F.col("added") == "compagnie") & (F.col("removed") != "cie")).select("rid", "s1", F.lit("R1_compagnie").alias("rule")))
    if raw is not None:
        said = lambda k, n: raw.select(F.col("eid").alias(k), F.size(F.regexp_extract_all("name", F.lit("france"), F.lit(0))).alias(n))
        twice = review.where(F.col("own") & (F.col("name_class") == "eq") & F.col("delta").isin(*decide.DELTAS)).join(said("rid", "qn"), "rid").join(said("s1", "sn"), "s1")
        out = out.unionByName(twice.where("qn > sn and sn >= 1").select("rid", "s1", F.lit("R2_dupfrance").alias("rule")))
    return out


def additions(proposed: DataFrame, review: DataFrame, scores: DataFrame, st: DataFrame) -> DataFrame:
    """(rid, s1, rule): proposals that the review lets pass."""
    at = st.withColumn("k", decide.address_key(F.col("address")))
    at = at.select(F.col("eid").alias("s1"), "k").join(at.groupBy("k").agg(F.count("*").alias("n_at")), "k").select("s1", "n_at")
    d = proposed.join(scores.select("rid", "s1", "p"), ["rid", "s1"], "left").join(review.select("rid", "s1", "added", "removed"), ["rid", "s1"], "left").join(at, "s1", "left")
    noise = F.col("rule").isin("A1", "A2")
    said = _within(_words("added"), KEEP_NOISE) | ((F.col("added") == "compagnie") & (F.col("removed") == "cie"))
    passes = (noise & said & ~((F.col("n_at") > 1) & (F.coalesce("p", F.lit(0.0)) < 0.1))) | (F.col("rule").isin("R5", "A5") & (F.col("p") >= 0.1)) | (F.col("rule") == "A3") | (F.col("rule").isin("N1", "N2") & (F.col("p") >= HALF))
    name = F.when(noise, "A1A2_noise").when(F.col("rule").isin("R5", "A5"), "R5A5").otherwise(F.col("rule"))
    return d.where(passes).select("rid", "s1", name.alias("rule"))


def partial_filter(new: DataFrame, previous: DataFrame, qt: DataFrame, st: DataFrame, ruled: DataFrame | None = None) -> DataFrame:
    """(rid, s1, origin): the new assignment without the pairs that only it has and whose addresses differ, and with those
    that only the previous one had and that are clearly the same, for records that have none now. Pairs of `ruled`, which
    rules made, aren't brought back."""
    pair, key = ["rid", "s1"], ["rid", "s1"]
    new, previous = new.select(*pair).distinct(), previous.select(*pair).distinct()
    only = lambda a, b: decide.reviewed(features.with_texts(a.join(b, key, "left_anti"), qt, st)).select(*pair, "verdict")
    kept = new.join(only(new, previous).where("verdict = 'diff_addr'"), key, "left_anti")
    back = only(previous, new).where(F.col("verdict").isin("same", "same_noise")).join(kept.select("rid"), "rid", "left_anti")
    back = back if ruled is None else back.join(ruled.select(*pair), key, "left_anti")
    return kept.select(*pair, F.lit("new").alias("origin")).unionByName(back.select(*pair, F.lit("restored").alias("origin")))


def rescue_gate(pool: DataFrame, qt: DataFrame, st: DataFrame, assigned: DataFrame, sure: float = 0.95, trim: int = 2) -> DataFrame:
    """(rid, s1): of a pool (rid, s1, ce as a probability) the best entity of each unassigned record, sure enough, whose
    classes say the same or the same but for noise, and whose names aren't more than `trim` edits apart where they differ."""
    d = pool.where(F.col("ce") >= sure).join(assigned.select("rid"), "rid", "left_anti")
    d = d.withColumn("at", F.row_number().over(W.partitionBy("rid").orderBy(F.desc("ce"), "s1"))).where("at = 1").drop("at")
    d = decide.reviewed(features.with_texts(d, qt, st)).where(F.col("verdict").isin("same", "same_noise"))
    return d.where((F.col("name_class") != "typo") | (F.levenshtein("q_name_core", "s_name_core") <= trim)).select("rid", "s1")


def change_gate(changes: DataFrame, qt: DataFrame, st: DataFrame, added: bool, lower: float, same: float = 0.7) -> DataFrame:
    """One row (n, lower_share, verdict_share, pass): additions need few lower-case names and mostly the same verdict,
    removals enough lower-case names and mostly another one."""
    d = decide.reviewed(features.with_texts(changes.select("rid", "s1"), qt, st))
    agreed = F.col("verdict").isin("same", "same_noise")
    hit = agreed if added else ~agreed
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    low = share(F.col("q_name_full") == F.lower("q_name_full"))
    d = d.agg(F.count("*").alias("n"), F.round(low, 6).alias("lower_share"), F.round(share(hit), 6).alias("verdict_share"))
    enough = F.col("lower_share") <= lower if added else F.col("lower_share") >= lower
    return d.withColumn("pass", enough & (F.col("verdict_share") >= same))
