"""Second-chance candidates for records that blocking left without an owner: key families under caps, gates, an acceptance
model, and keys of names short of a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from erloom.functions import similarity as sim
from erloom.sources.store import staged

from . import features, models

# fixed values: words that no rescue key is made of
LEGAL = ("limited", "ltd", "llc", "llp", "lp", "inc", "pvt", "corp", "corporation", "co", "company", "the", "and", "of", "et", "pllc", "plc", "pc")
NAME_STOP = ("limited", "ltd", "llc", "llp", "lp", "inc", "pvt", "corp", "corporation", "co", "company", "the", "and", "of", "et", "pllc", "plc", "pc", "private", "public", "m", "s")
#: Entities that may hold a key of each family: for a key at all, and for a pair that is kept; `anum` needs one entity, or
#: three with two keys in common.
KEY_CAP = 10
CAPS = {"aexact": 3, "corenum": 5, "cat": 10, "anum": 3, "aalpha": 1, "typo": 10}
#: Families by how much they say; those that need no unknown word; those whose pairs must share an address word.
PRIORITY = {"aexact": 6, "corenum": 5, "cat": 4, "anum": 3, "aalpha": 2, "typo": 1}
UNGATED, ADDRESS_CHECKED = ("aexact",), ("cat", "typo", "corenum")
TOP, SUBSET_WORDS = 5, 7
ACCEPT = 0.7


def _parts(df: DataFrame) -> DataFrame:
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != "")
    d = df.select("eid", "country", F.coalesce("name_core", F.lit("")).alias("core"), words("name_core").alias("ct"), F.filter(words("name_full"), lambda w: ~w.isin(*LEGAL)).alias("ft"), F.array_distinct(words("address")).alias("ad"))
    digits = F.filter(F.transform("ad", lambda w: F.regexp_extract(w, "([0-9]+)", 1)), lambda n: n != "")
    return d.withColumns({"al": F.filter("ad", lambda w: w.rlike("^[a-z]{4,}$")), "nums": F.array_distinct(digits)})


def letters(text: Column) -> Column:
    """The letters of a text in order."""
    return F.array_join(F.array_sort(F.split(text, "")), "")


def _glued(c: str) -> Column:
    return F.replace(F.col(c), F.lit(" "), F.lit(""))


def _subsets(words: Column) -> Column:
    """Every choice of two or more of the words, run together, by the bits of a number."""
    masks = F.filter(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(words)) - 1), lambda m: F.bit_count(m) >= 2)
    picked = lambda m: F.array_join(F.filter(words, lambda w, i: F.call_function("shiftright", m, i) % 2 == 1), "")
    return F.when(F.size(words) >= 2, F.transform(masks, picked)).otherwise(F.array().cast("array<string>"))


def _family(kind: str, entity: bool) -> Column:
    """The keys of one family as an array, of the entity's or the record's side."""
    none = F.array().cast("array<string>")
    if kind == "aexact":
        return F.when((F.size("ad") >= 3) & F.exists("ad", lambda w: w.rlike("[0-9]")), F.array(F.array_join(F.array_sort("ad"), " "))).otherwise(none)
    if kind == "corenum":
        return F.when(F.length(_glued("core")) >= 3, F.transform("nums", lambda n: F.concat(_glued("core"), F.lit("|"), n))).otherwise(none)
    if kind == "anum":
        return F.array_distinct(F.flatten(F.transform("nums", lambda n: F.transform("al", lambda a: F.concat(n, F.lit("|"), letters(a))))))
    if kind == "aalpha":
        some = F.slice("al", 1, 8)
        return F.array_distinct(F.flatten(F.transform(some, lambda a, i: F.transform(F.filter(some, lambda b, j: j > i), lambda b: F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b))))))
    if kind == "cat" and entity:
        return F.array_distinct(F.transform(F.filter(_subsets(F.slice("ft", 1, SUBSET_WORDS)), lambda t: F.length(t) >= 7), letters))
    if kind == "cat":
        whole = F.when(F.length(_glued("core")) >= 7, F.array(letters(_glued("core")))).otherwise(none)
        return F.array_distinct(F.concat(whole, F.transform(F.filter("ct", lambda w: F.length(w) >= 8), letters)))
    raise ValueError(kind)


def _typo(parts: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """(eid, k): a word as anchor, and another word's letters, whole or short of one. With a vocabulary (country, w) the
    other word must be unknown to it."""
    words = parts.select("eid", "country", F.posexplode(F.slice("ct", 1, 5)).alias("i", "w"))
    other = words if vocabulary is None else words.join(vocabulary, ["country", "w"], "left_anti")
    distinct = other.where(F.length("w") >= 4).select("w").distinct()
    short = lambda t: F.array_distinct(F.concat(F.array(t), F.transform(F.sequence(F.lit(1), F.length(t)), lambda j: F.concat(t.substr(F.lit(1), j - 1), t.substr(j + 1, F.length(t))))))
    variants = distinct.select("w", F.explode(short(letters(F.col("w")))).alias("v"))
    both = other.select("eid", F.col("i").alias("j"), "w").join(words.where(F.length("w") >= 3).select("eid", "country", "i", F.col("w").alias("anchor")), "eid").where("i <> j").join(variants, "w")
    return both.select("eid", "country", F.concat("anchor", F.lit("|"), "v").alias("k")).distinct()


def keys(df: DataFrame, entity: bool, vocabulary: DataFrame | None = None, only: dict[str, DataFrame] | None = None) -> DataFrame:
    """(fam, country, k, eid) of all families; `only` restricts the entities or records of a family by eid."""
    parts, out = _parts(df), None
    for kind in CAPS:
        own = parts if not only else parts.join(only[kind], "eid", "left_semi")
        one = _typo(own, vocabulary) if kind == "typo" else own.select("eid", "country", F.explode(_family(kind, entity)).alias("k"))
        one = one.select(F.lit(kind).alias("fam"), "country", "k", "eid")
        out = one if out is None else out.unionByName(one)
    return out


def unknown_words(records: DataFrame, entities: DataFrame) -> DataFrame:
    """(eid): records with a core word of three or more letters that no full name of an entity of the country has."""
    known = entities.select("country", F.explode(F.split("name_full", " ")).alias("w")).distinct()
    return records.select("eid", "country", F.explode(F.split("name_core", " ")).alias("w")).where(F.length("w") >= 3).join(known, ["country", "w"], "left_anti").select("eid").distinct()


def selected(records: DataFrame, entities: DataFrame, cand: DataFrame) -> DataFrame:
    """(rid, s1, family, nfam, mindf, rk): for each record the best TOP entities outside its candidates, by the number of
    families they share, the family that says most, and the rarity of the key."""
    known = entities.select("country", F.explode(F.split("name_full", " ")).alias("w")).distinct()
    gate = staged(unknown_words(records, entities), "gate")
    every = records.select("eid")
    own = staged(keys(entities, True), "rescue_keys")
    rare = own.groupBy("fam", "country", "k").agg(F.count("*").alias("df")).where(F.col("df") <= KEY_CAP)
    asked = keys(records, False, known, {k: every if k in UNGATED else gate for k in CAPS}).withColumnRenamed("eid", "rid")
    hits = asked.join(rare, ["fam", "country", "k"]).join(own.withColumnRenamed("eid", "s1"), ["fam", "country", "k"])
    pairs = hits.groupBy("rid", "s1", "fam").agg(F.min("df").alias("df"), F.count("*").alias("nk")).join(cand.select("rid", "s1"), ["rid", "s1"], "left_anti")
    cap = F.create_map(*[F.lit(x) for kv in CAPS.items() for x in kv])[F.col("fam")]
    pairs = pairs.where((F.col("df") <= cap) & ((F.col("fam") != "anum") | (F.col("df") <= 1) | (F.col("nk") >= 2)))
    place = lambda df, key, k: df.select(F.col("eid").alias(key), F.array_distinct(F.filter(F.split(F.coalesce("address", F.lit("")), " "), lambda w: (F.length(w) >= 3) | w.rlike("^[0-9]+$"))).alias(k))
    near = pairs.join(place(records, "rid", "qa"), "rid").join(place(entities, "s1", "sa"), "s1").where(~F.col("fam").isin(*ADDRESS_CHECKED) | (F.size("qa") == 0) | F.arrays_overlap("qa", "sa"))
    says = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("fam")]
    found = near.groupBy("rid", "s1").agg(F.array_join(F.array_sort(F.collect_set("fam")), ",").alias("family"), F.count("*").alias("nfam"), F.max(says).alias("best"), F.min("df").alias("mindf"))
    at = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("nfam"), F.desc("best"), "mindf", "s1"))
    return found.withColumn("rk", at.cast("long")).where(F.col("rk") <= TOP).select("rid", "s1", "family", "nfam", "mindf", "rk")


FEATURES = [*[f"fam_{k}" for k in CAPS], "n_families", "name_token_set", "name_ratio", "address_token_set", "address_missing", "ce", "jw"]


def acceptance_features(pairs: DataFrame, qt: DataFrame, st: DataFrame) -> DataFrame:
    """pairs (rid, s1, family) with the acceptance model's features but the text score; an address similarity of -1 means
    that the record has no address."""
    d = features.with_texts(pairs, qt, st)
    udf, glued = sim.UDFS, lambda k: _glued(f"{k}_name_full")
    made = {f"fam_{k}": F.array_contains(F.split("family", ","), k).cast("int") for k in CAPS}
    made |= {
        "n_families": F.size(F.split("family", ",")), "address_missing": (F.col("q_address") == "").cast("int"),
        "name_token_set": udf["token_set_ratio"]("q_name_full", "s_name_full"), "name_ratio": udf["ratio"](glued("q"), glued("s")),
        "address_token_set": F.when(F.col("q_address") == "", -1.0).otherwise(udf["token_set_ratio"]("q_address", "s_address")), "jw": udf["jaro_winkler"]("q_name_full", "s_name_full"),
    }
    text = {f"{k}_text": F.concat(F.col(f"{k}_name_full"), F.lit(" | "), F.col(f"{k}_address")) for k in "qs"}
    return d.withColumns(made | text).select(*pairs.columns, *made, *text)


def accepted(pairs: DataFrame, truth: DataFrame, qt: DataFrame, st: DataFrame, threshold: float = ACCEPT) -> DataFrame:
    """(rid, s1): the best entity of each record by the acceptance model, at the threshold or above. The model, trees over
    FEATURES with a text score, is out of fold by entity; without both classes in both folds nothing is accepted."""
    label = truth.select("rid", "s1", F.lit(1).alias("label"))
    rows = staged(acceptance_features(pairs.select("rid", "s1", "family"), qt, st).join(label, ["rid", "s1"], "left").fillna(0, ["label"]), "acceptance")
    fold = models.halves("s1")
    seen = rows.groupBy(fold.alias("half")).agg(F.countDistinct("label").alias("n")).collect()  # two rows
    if len(seen) < 2 or min(r.n for r in seen) < 2:
        return rows.select("rid", "s1").where("false")
    ce = staged(models.out_of_fold(rows, ["q_text", "s_text"], fold, "ce", fit=models.fit_text, apply=models.score_text), "acceptance_text")
    scored = models.out_of_fold(ce, FEATURES, fold, "ps", rounds=20, depth=3)
    at = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("ps"), "s1"))
    return scored.where(F.col("ps") >= threshold).withColumn("at", at).where("at = 1").select("rid", "s1")


def _sorted_words(name: str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(name, F.lit("")), " "), lambda w: (w != "") & ~w.isin(*NAME_STOP))))


def name_key_arrays(kind: str) -> Column:
    """Keys of a name's sorted words (nm: whole and short of one word), also short of a word but for its first letter (hc),
    or of an address's first two numbers with its first six words (adr)."""
    w, none = _sorted_words("name_full"), F.array().cast("array<string>")
    joined = lambda a: F.array_join(a, " ")
    some = F.size(w).between(2, 8)
    short = F.transform(w, lambda x: joined(F.array_remove(w, x)))
    plain = F.when(some, F.concat(F.array(joined(w)), short)).when(F.size(w) == 1, w).otherwise(none)
    if kind == "nm":
        return plain
    if kind == "hc":
        first = F.transform(F.filter(w, lambda x: F.length(x) >= 3), lambda x: F.concat(joined(F.array_remove(w, x)), F.lit("|"), F.substring(x, 1, 1)))
        return F.concat(plain, F.when(some, first).otherwise(none))
    words = F.split(F.coalesce("address", F.lit("")), " ")
    numbers = F.slice(F.filter(F.transform(words, lambda x: F.regexp_extract(x, "([0-9]+)", 1)), lambda n: n != ""), 1, 2)
    streets = F.slice(F.filter(words, lambda x: x.rlike("^[a-z]{4,}$")), 1, 6)
    return F.array_distinct(F.flatten(F.transform(numbers, lambda n: F.transform(streets, lambda x: F.concat(n, F.lit("|"), x)))))


#: Name-key families: keys, which records are asked (all, those without an address, those with one), whether records with
#: candidates are passed over, and how many entities are kept.
NAME_FAMILIES = {"nm1": ("nm", "all", False, 3), "nm1b": ("nm", "without", False, 3), "nm1c": ("nm", "without", True, 3), "nm1d": ("hc", "without", True, 5), "hc": ("hc", "without", False, 5), "hca": ("hc", "with", False, 5), "adr": ("adr", "with", True, 5)}


def name_key_pairs(kind: str, records: DataFrame, entities: DataFrame, cand: DataFrame, df_max: int = 3) -> DataFrame:
    """(rid, s1, jw, rk) of one name-key family: entities that share a key which at most df_max entities hold, outside the
    record's candidates, the best by Jaro-Winkler of the full names."""
    made, which, fresh, top = NAME_FAMILIES[kind]
    asked = {"all": records, "without": records.where("address = ''"), "with": records.where("address <> ''")}[which]
    asked = asked.join(cand.select(F.col("rid").alias("eid")).distinct(), "eid", "left_anti") if fresh else asked
    side = lambda df, key: df.select(F.col("eid").alias(key), "country", F.explode(F.array_distinct(name_key_arrays(made))).alias("k"))
    own = side(entities, "s1")
    rare = own.groupBy("country", "k").agg(F.count("*").alias("df")).where(F.col("df") <= df_max)
    pairs = side(asked, "rid").join(rare, ["country", "k"], "left_semi").join(own, ["country", "k"]).select("rid", "s1").distinct().join(cand.select("rid", "s1"), ["rid", "s1"], "left_anti")
    name = lambda df, key, k: df.select(F.col("eid").alias(key), F.col("name_full").alias(k))
    near = pairs.join(name(records, "rid", "qn"), "rid").join(name(entities, "s1", "sn"), "s1").withColumn("jw", sim.UDFS["jaro_winkler"]("qn", "sn"))
    at = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("jw"), "s1"))
    return near.withColumn("rk", at.cast("long")).where(F.col("rk") <= top).select("rid", "s1", F.round("jw", 6).alias("jw"), "rk")


def name_key_features(pairs: DataFrame, qt: DataFrame, st: DataFrame, ce: str = "jw") -> DataFrame:
    """pairs with the features of the name-key gate: similarities, how many the record has, and the margin of a score to the
    record's next best, or to its best."""
    d = features.with_texts(pairs, qt, st)
    of = W.partitionBy("rid")
    at = F.row_number().over(of.orderBy(F.desc(ce), "s1"))
    d = d.withColumns({"token_set": sim.UDFS["token_set_ratio"]("q_name_full", "s_name_full"), "glued": sim.UDFS["ratio"](_glued("q_name_full"), _glued("s_name_full")), "n": F.count("*").over(of), "_top": F.max(ce).over(of), "_at": at})
    d = d.withColumn("_second", F.coalesce(F.max(F.when(F.col("_at") == 2, F.col(ce))).over(of), F.lit(-10.0)))
    margin = F.when(F.col(ce) >= F.col("_top"), F.col(ce) - F.col("_second")).otherwise(F.col(ce) - F.col("_top"))
    return d.select(*pairs.columns, F.round("token_set", 6).alias("token_set"), F.round("glued", 6).alias("glued"), "n", F.round(margin, 6).alias("margin"))
