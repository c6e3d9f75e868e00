"""Features of candidate pairs, as columns over whole tables: blocking, overlap, numbers, legal forms, fuzzy similarity,
standing among a record's and an entity's other pairs, and how a record fits the other records of its entity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erloom.functions import similarity as sim
from erloom.sources.fixtures import LEGAL_CODES, SHIFTS

SOURCE = 10_000_000_000
#: Siblings are other records whose best entity is this one with at least this probability; pairs below the floor have
#: no odd features.
SIBLING_P, SURE_P, TEXT_P = 0.5, 0.9, 0.001
#: A word counts as matched by a word of the other name from this ratio on.
MATCHED = 80
# fixed values: words that say nothing about a name
LEGAL_WORDS = ("pvt", "private", "ltd", "limited", "llp", "llc", "inc", "incorporated", "corp", "corporation", "co", "company", "lp", "plc", "pllc", "pc", "sarl", "sas", "sasu", "eurl", "sa", "sci", "snc", "gmbh")
STOP_WORDS = ("the", "and", "of", "et", "de", "du", "des", "la", "le", "les", "ms", "m", "s", "shri", "sri", "smt", "mr", "mrs", "dr", "dba", "formerly", "known", "as", "com", "www", "d", "l", "a")


def tokens(source: DataFrame) -> DataFrame:
    """`source` with the words of two letters or more of name_core and address, the whole numbers of the address, and the
    codes of the legal forms in name_full."""
    some = lambda col: F.filter(F.split(col, " "), lambda w: F.length(w) >= 2)
    codes = F.create_map(*[F.lit(x) for pair in LEGAL_CODES.items() for x in pair])
    forms = F.filter(F.transform(F.split("name_full", " "), lambda w: F.try_element_at(codes, w)), lambda c: c.isNotNull())
    return source.withColumns({"name_words": some("name_core"), "address_words": some("address"), "numbers": F.regexp_extract_all("address", F.lit(r"\b[0-9]+\b"), F.lit(0)), "forms": F.array_distinct(forms)})


def record_stats(cand: DataFrame) -> DataFrame:
    """Best and second score and the number of candidates of each record."""
    return cand.groupBy("rid").agg(F.max("score").alias("top1"), F.max(F.when(F.col("rk") == 2, F.col("score"))).alias("top2"), F.count("*").alias("ncand"))


def entity_stats(cand: DataFrame) -> DataFrame:
    """Number of candidates, of those at rank 1, and best score of each entity."""
    return cand.groupBy("s1").agg(F.count("*").alias("n_cand"), F.count_if(F.col("rk") == 1).alias("n_top1"), F.max("score").alias("max_score"))


def with_texts(pairs: DataFrame, qt: DataFrame, st: DataFrame) -> DataFrame:
    """pairs with the columns of both sides' texts as q_... and s_...."""
    side = lambda df, k, key: df.select(F.col("eid").alias(key), *[F.col(c).alias(f"{k}_{c}") for c in ("country", "name_core", "name_full", "address", "name_words", "address_words", "numbers", "forms")])
    return pairs.join(side(qt, "q", "rid"), "rid").join(side(st, "s", "s1").drop("s_country"), "s1")


def _jaccard(a: str, b: str) -> Column:
    return F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), 6)


def _first(a: str) -> Column:
    return F.get(F.col(a), F.lit(0))


def _flag(c: Column) -> Column:
    return c.cast("int")


def overlap_columns() -> dict[str, Column]:
    return {
        "name_jaccard": _jaccard("q_name_words", "s_name_words"),
        "address_jaccard": _jaccard("q_address_words", "s_address_words"),
        "name_first_equal": _flag(_first("q_name_words") == _first("s_name_words")),
    }


def number_columns() -> dict[str, Column]:
    """Null where a side has no number to compare."""
    value = lambda a: F.expr(f"try_cast(get({a}, 0) as double)")
    own, other = F.col("q_numbers"), F.col("s_numbers")
    missing = F.size(F.filter(own, lambda x: ~F.array_contains(other, x)))
    return {
        "num_common": F.size(F.array_intersect(own, other)).cast("long"),
        "q_num_count": F.size(own).cast("long"),
        "s_num_count": F.size(other).cast("long"),
        "q_nums_unmatched": missing.cast("long"),
        "nums_subset": _flag((F.size(own) > 0) & (missing == 0)),
        "first_num_equal": _flag(_first("q_numbers") == _first("s_numbers")),
        "first_num_diff": F.abs(value("q_numbers") - value("s_numbers")),
    }


def legal_columns() -> dict[str, Column]:
    own, other = F.size("q_forms"), F.size("s_forms")
    common = F.size(F.array_intersect("q_forms", "s_forms"))
    return {"q_legal_n": own.cast("long"), "s_legal_n": other.cast("long"), "legal_same": _flag(common > 0), "legal_clash": _flag((common == 0) & (own > 0) & (other > 0))}


def text_columns() -> dict[str, Column]:
    sizes = {f"{k}_{short}_len": F.length(f"{k}_{col}").cast("long") for k in "qs" for short, col in (("name", "name_core"), ("address", "address"))}
    # the registry is plain ASCII; a name that was transliterated differs from its ASCII reading
    return sizes | {"address_missing": _flag(F.col("q_address") == ""), "s1_address_missing": _flag(F.col("s_address") == ""), "name_translit": _flag(F.col("q_name_full").rlike(r"[^\x00-\x7F]"))}


def standing_columns() -> dict[str, Column]:
    """From the pair's own score and the stats of its record and entity."""
    return {
        "source": F.expr(f"rid div {SOURCE}"),
        "score_ratio": F.round(F.col("score") / F.col("top1"), 6),
        "gap_top1": F.col("top1") - F.col("score"),
        "record_margin": F.col("top1") - F.coalesce("top2", F.lit(0.0)),
        "s1_n_cand": F.col("n_cand"),
        "s1_n_top1": F.col("n_top1"),
        "score_ratio_s1": F.round(F.col("score") / F.col("max_score"), 6),
    }


def pair_features(cand: DataFrame, qt: DataFrame, st: DataFrame) -> DataFrame:
    """The 34 relational features of every candidate pair."""
    joined = with_texts(cand.join(record_stats(cand), "rid").join(entity_stats(cand), "s1"), qt, st)
    made = standing_columns() | text_columns() | overlap_columns() | number_columns() | legal_columns()
    return joined.select("rid", "s1", "score", "nkeys", "rk", "top1", "top2", "ncand", *[c.alias(name) for name, c in made.items()])


#: Fuzzy features: name, the two columns compared, the similarity.
FUZZY = (
    [(f"name_{short}", "name_core", f) for short, f in (("ratio", sim.ratio), ("token_sort", sim.token_sort_ratio), ("token_set", sim.token_set_ratio), ("partial", sim.partial_ratio), ("jw", sim.jaro_winkler))]
    + [(f"name_full_{short}", "name_full", f) for short, f in (("ratio", sim.ratio), ("token_set", sim.token_set_ratio))]
    + [(f"address_{short}", "address", f) for short, f in (("ratio", sim.ratio), ("token_sort", sim.token_sort_ratio), ("token_set", sim.token_set_ratio), ("partial", sim.partial_ratio))]
)


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name, _, _ in FUZZY]))
def _fuzzy(q_core: pd.Series, s_core: pd.Series, q_full: pd.Series, s_full: pd.Series, q_address: pd.Series, s_address: pd.Series) -> pd.DataFrame:
    sides = {"name_core": (q_core, s_core), "name_full": (q_full, s_full), "address": (q_address, s_address)}
    return pd.DataFrame({name: sim.over_distinct(f, *sides[col]).round(6) for name, col, f in FUZZY})


def fuzzy_column() -> Column:
    """The 11 fuzzy features of pairs with_texts() as one struct."""
    return _fuzzy("q_name_core", "s_name_core", "q_name_full", "s_name_full", "q_address", "s_address")


def fuzzy_features(pairs: DataFrame, qt: DataFrame, st: DataFrame) -> DataFrame:
    """(rid, s1) and the 11 fuzzy features."""
    both = with_texts(pairs.select("rid", "s1"), qt, st)
    found = both.select("rid", "s1", fuzzy_column().alias("f"))
    return found.select("rid", "s1", "f.*")


#: Similarities whose gap to the record's best and rank among its pairs are features too.
RELATIVE = ("combined", "name_token_set", "name_ratio", "name_jw", "name_full_ratio", "address_token_set", "address_ratio")


def relative_features(fuzzy: DataFrame) -> DataFrame:
    """(rid, s1), the combined similarity, and for each of RELATIVE the gap to the best of the record and the rank."""
    scored = fuzzy.withColumn("combined", F.round(F.col("name_token_set") + F.col("address_token_set"), 6))
    of_record = W.partitionBy("rid")
    made = [c.alias(n) for x in RELATIVE for n, c in ((f"{x}_gap", F.round(F.col(x) - F.max(x).over(of_record), 6)), (f"{x}_rank", F.rank().over(of_record.orderBy(F.desc(x))).cast("long")))]
    return scored.select("rid", "s1", "combined", *made)


def context_features(scored: DataFrame) -> DataFrame:
    """(rid, s1) and a pair's standing by probability p among its record's and its entity's pairs (rid, s1, p, combined).

    A pair is best where its p equals the record's highest, so ties make several best. Of the entity's best pairs the
    pair itself is left out; `s_max_other` is 0 where no other is left."""
    of_record, of_entity = W.partitionBy("rid"), W.partitionBy("s1")
    d = scored.withColumns({"r_top1": F.max("p").over(of_record), "r_n": F.count("*").over(of_record), "at": F.row_number().over(of_record.orderBy(F.desc("p"), "s1"))})
    d = d.withColumns({"r_second": F.coalesce(F.max(F.when(F.col("at") == 2, F.col("p"))).over(of_record), F.lit(0.0)), "best": F.col("p") == F.col("r_top1")})
    d = d.withColumn("among", F.row_number().over(W.partitionBy("s1", "best").orderBy(F.desc("p"), "rid")))
    best = lambda c: F.when(F.col("best"), c)
    top = lambda k: F.max(best(F.when(F.col("among") == k, F.col("p")))).over(of_entity)
    d = d.withColumns({
        "s_n": F.count("*").over(of_entity),
        "s_best": F.count(best(F.lit(1))).over(of_entity),
        "s_conf": F.count(best(F.when(F.col("p") >= 0.5, 1))).over(of_entity),
        "s_sum": F.coalesce(F.sum(best(F.round(F.col("p") * 1e9).cast("long"))).over(of_entity), F.lit(0)),
        "t1": top(1), "t2": top(2), "s_combined": F.max("combined").over(of_entity),
    })
    own, other = F.col("best"), F.when(F.col("t1").isNull(), 0.0).when(F.col("best") & (F.col("p") == F.col("t1")), F.coalesce("t2", F.lit(0.0))).otherwise(F.col("t1"))
    return d.select(
        "rid", "s1", "r_second", "r_n",
        F.round(F.col("p") - F.col("r_top1"), 6).alias("p_gap_rid"),
        F.round(F.col("p") - F.when(own, F.col("r_second")).otherwise(F.col("r_top1")), 6).alias("p_margin"),
        _flag(own).alias("is_best"),
        (F.col("s_best") - _flag(own)).alias("s_n_best_other"),
        (F.col("s_conf") - _flag(own & (F.col("p") >= 0.5))).alias("s_n_conf_other"),
        F.round((F.col("s_sum") - F.when(own, F.round(F.col("p") * 1e9).cast("long")).otherwise(0)) / 1e9, 6).alias("s_sum_other"),
        other.alias("s_max_other"),
        F.col("s_n").alias("s_n_pairs"),
        F.round(F.col("combined") - F.col("s_combined"), 6).alias("combined_gap_s1"),
    )


def best_of_record(scored: DataFrame) -> DataFrame:
    """(rid, s1, p) of each record's likeliest entity, the smaller id where two are as likely."""
    top = F.max(F.struct("p", (-F.col("s1")).alias("s"))).alias("t")
    return scored.where("p is not null").groupBy("rid").agg(top).select("rid", (-F.col("t.s")).alias("s1"), F.col("t.p").alias("p"))


def _runs(address: str) -> Column:
    """Every run of digits in an address, without leading zeros."""
    return F.transform(F.regexp_extract_all(F.coalesce(address, F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda n: F.regexp_replace(n, "^0+(?=[0-9])", ""))


def _value(n: Column) -> Column:
    return F.substring(n, 1, 9).cast("long")


_WORDS = T.StructType([T.StructField("added", T.ArrayType(T.StringType())), T.StructField("removed", T.ArrayType(T.StringType()))])


def _unmatched(names: list[tuple[list[str], list[str]]]) -> list[list[str]]:
    """Of each pair of word lists, the real words of the first that the second doesn't have, whole, inside or alike."""
    open_, left, right = [], [], []
    for own, other in names:
        have, joined = set(other), "".join(other)
        some = [w for w in dict.fromkeys(own) if w not in have and len(w) >= 2 and not w.isdigit() and w not in LEGAL_WORDS and w not in STOP_WORDS and not (len(w) >= 4 and w in joined)]
        open_.append([(w, len(left) + i * len(other), len(left) + (i + 1) * len(other)) for i, w in enumerate(some)])
        left += [w for w in some for _ in other]
        right += other * len(some)
    near = np.concatenate([[0], np.cumsum(sim.ratio(left, right) >= MATCHED)]) if left else np.zeros(1, dtype=np.int64)
    return [[w for w, a, b in some if near[b] == near[a]] for some in open_]


@F.pandas_udf(_WORDS)
def changed_words(query: pd.Series, entity: pd.Series) -> pd.DataFrame:
    """Real words of a name that the other name has no match for, both ways."""
    both = [(a.split(), b.split()) for a, b in zip(query.fillna(""), entity.fillna(""), strict=True)]
    return pd.DataFrame({"added": _unmatched(both), "removed": _unmatched([(b, a) for a, b in both])})


def _unexplained(own: Column, other: Column, known: Column) -> Column:
    """Numbers of `own` that neither the entity's numbers nor the siblings' have, that are no part of a longer one of the
    entity's, and that join with the number before or after to none."""
    inside = lambda a, longer: F.exists(other, lambda b: F.contains(b, a) & ((F.length(b) > F.length(a)) if longer else F.lit(True)))

    def open_(a: Column, i: Column) -> Column:
        after, before = F.get(own, i + 1), F.get(own, i - 1)
        joined = (after.isNotNull() & inside(F.concat(a, F.coalesce(after, F.lit("")))  , False)) | ((i > 0) & before.isNotNull() & inside(F.concat(F.coalesce(before, F.lit("")), a), False))
        return ~(F.array_contains(other, a) | F.array_contains(known, a) | inside(a, True) | joined)

    return F.size(F.filter(own, open_))


def odd_features(scored: DataFrame, qt: DataFrame, st: DataFrame, decoys: DataFrame, replacements: DataFrame) -> DataFrame:
    """(rid, s1) and the 28 odd-one-out features of the pairs (rid, s1, p) with p of TEXT_P or more.

    Siblings are joined row by row, so a large entity is many rows that an exchange can split, not one long array; what
    is collected from them are sets of the pair's own words and numbers. decoys and replacements are (country, words)."""
    text = lambda df, key, k: df.select(F.col("eid").alias(key), F.col("name_core").alias(f"{k}_name"), F.col("address").alias(f"{k}_address"), *([F.col("country")] if k == "q" else []))
    sib = best_of_record(scored).where(F.col("p") >= SIBLING_P).join(text(qt.drop("country"), "rid", "b"), "rid")
    sib = sib.select(F.col("rid").alias("b_rid"), "s1", F.col("p").alias("b_p"), "b_name", "b_address", _runs("b_address").alias("b_numbers"), F.split("b_name", " ").alias("b_words"))
    pairs = scored.where(F.col("p") >= TEXT_P).select("rid", "s1").join(text(qt, "rid", "q"), "rid").join(text(st, "s1", "s"), "s1")
    pairs = pairs.withColumns({"qn": _runs("q_address"), "sn": _runs("s_address"), "w": changed_words("q_name", "s_name")})
    token = lambda c: F.split(F.coalesce(c, F.lit("")), " ")
    suffixed = F.filter(token("q_address"), lambda t: t.rlike("^[a-z]?[0-9]+[a-z]$") & ~t.rlike("^[0-9]+(st|nd|rd|th)$"))
    pairs = pairs.withColumns({"qx": F.array_except("qn", "sn"), "sx": F.array_except("sn", "qn"), "suffix": F.array_except(suffixed, token("s_address")), "q1": _first("qn"), "s1n": _first("sn"), "added": F.col("w.added"), "removed": F.col("w.removed")}).drop("w")
    keep = ["rid", "s1", "q_name", "s_name", "q_address", "s_address", "qn", "sn", "qx", "sx", "suffix", "added", "removed"]
    near = pairs.select(*keep, "q1", "s1n").join(sib, "s1").where("b_rid <> rid")
    likeness = sim.UDFS["ratio"]
    near = near.withColumns({"name_like": likeness("q_name", "b_name"), "address_like": likeness("q_address", "b_address")})
    of = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    other_source = F.expr(f"b_rid div {SOURCE} <> rid div {SOURCE}")
    found = near.groupBy("rid", "s1").agg(
        F.count("*").alias("o_n5"), F.count_if(F.col("b_p") >= SURE_P).alias("o_n9"), F.count_if((F.col("b_p") >= SURE_P) & other_source).alias("o_n9_x"),
        F.round(F.max("name_like"), 6).alias("o_name_sib"), F.round(F.max("address_like"), 6).alias("o_addr_sib"),
        F.count_if(F.col("q_name") == F.col("b_name")).alias("o_name_eq_sib"), F.count_if(F.col("q_address") == F.col("b_address")).alias("o_addr_eq_sib"),
        F.count_if(F.array_contains("b_numbers", F.col("q1"))).alias("q1_sib"), F.count_if(F.array_contains("b_numbers", F.col("s1n"))).alias("s1_sib"),
        of(F.array_intersect("qn", "b_numbers")).alias("known"), of(F.array_intersect("added", "b_words")).alias("backed"),
        of(F.array_except("removed", "b_words")).alias("gone"), F.max(F.arrays_overlap("suffix", token("b_address"))).alias("suffix_sib"),
    )
    d = pairs.join(found, ["rid", "s1"], "left").join(decoys.withColumnRenamed("words", "decoy_words"), "country", "left").join(replacements.withColumnRenamed("words", "new_words"), "country", "left")
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    known, backed = F.coalesce("known", none), F.coalesce("backed", none)
    delta = _value(F.col("q1")) - _value(F.col("s1n"))
    both = F.col("q1").isNotNull() & F.col("s1n").isNotNull()
    shifts = F.flatten(F.transform("qx", lambda a: F.transform("sx", lambda b: _value(a) - _value(b))))
    in_ = lambda values: _flag(F.exists(shifts, lambda x: x.isin(*values)))
    q1_sib, s1_sib = F.coalesce("q1_sib", zero), F.coalesce("s1_sib", zero)
    lettered = F.filter(token("q_name"), lambda t: (F.length(t) >= 3) & t.rlike("^[a-z]+$"))
    listed = lambda words, col: F.size(F.array_intersect(words, F.coalesce(col, none))) > 0
    return d.select(
        "rid", "s1", *[F.coalesce(c, zero).alias(c) for c in ("o_n5", "o_n9", "o_n9_x")],
        "o_name_sib", F.round(F.col("o_name_sib") - likeness("q_name", "s_name"), 6).alias("o_name_rel"),
        "o_addr_sib", F.round(F.col("o_addr_sib") - likeness("q_address", "s_address"), 6).alias("o_addr_rel"),
        "o_name_eq_sib", "o_addr_eq_sib",
        F.greatest(F.least(delta, F.lit(100)), F.lit(-100)).alias("o_d1"),
        F.when(~both, None).when(delta == 0, 0).when(delta.isin(*SHIFTS), 1).when(delta.isin(1, 2), 2).when(delta.isin(-1, -2), 3).otherwise(4).alias("o_d1_cls"),
        in_(SHIFTS).alias("o_shift_d8"), in_((1, 2)).alias("o_shift_p12"), in_((-1, -2)).alias("o_shift_n12"),
        F.when(F.col("q1").isNotNull(), q1_sib).alias("o_q1_sib"), F.when(F.col("s1n").isNotNull(), s1_sib).alias("o_s1_sib"),
        F.when(both, _flag((F.col("q1") != F.col("s1n")) & (s1_sib > 0) & (q1_sib == 0))).alias("o_odd_num"),
        F.size("qx").alias("o_qx_n"), F.size(F.array_intersect("qx", known)).alias("o_qx_sib"),
        F.when(F.size("qx") > 0, _unexplained(F.col("qn"), F.col("sn"), known)).otherwise(0).alias("o_qx_unexpl"),
        _flag(F.size("suffix") > 0).alias("o_sfx_new"), _flag(F.coalesce("suffix_sib", F.lit(False))).alias("o_sfx_sib"),
        F.size("added").alias("o_add_n"), (F.size("added") - F.size(backed)).alias("o_add_unsup"),
        F.size("removed").alias("o_rem_n"), F.when(F.col("o_n5").isNotNull(), F.size("removed") - F.size(F.coalesce("gone", none))).alias("o_rem_kept"),
        _flag(listed(F.array_except(lettered, token("s_name")), "decoy_words")).alias("o_veto"),
        _flag(listed(F.filter("added", lambda t: F.length(t) >= 3), "new_words")).alias("o_l2"),
    )
