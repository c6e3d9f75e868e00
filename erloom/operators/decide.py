"""Decisions over scored pairs: expected F0.5, difference classes of names and addresses, verdicts, vetoes, word lists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erloom.functions import similarity as sim

from . import features

#: Records of an entity that are weighed; those past them are never kept.
MOST = 12


def best_counts(p: np.ndarray, n: np.ndarray, beta: float = 0.5) -> np.ndarray:
    """How many of each row's first n probabilities (rows sorted from the top, zeros behind) to keep for the highest
    expected F-measure; of equal ones the fewest.

    Numbers of true records among the kept and the dropped follow two Poisson-binomial distributions; keeping none
    scores 1 only if none is true."""
    rows, most = p.shape
    b2 = beta * beta
    kept = np.zeros((rows, most + 1))
    kept[:, 0] = 1
    dropped = [np.zeros((rows, most + 1))]
    dropped[0][:, 0] = 1

    def with_one(dist: np.ndarray, q: np.ndarray) -> np.ndarray:
        moved = np.zeros_like(dist)
        moved[:, 1:] = dist[:, :-1]
        return dist * (1 - q[:, None]) + moved * q[:, None]

    for i in range(most - 1, -1, -1):
        dropped.append(with_one(dropped[-1], p[:, i]))
    dropped = dropped[::-1]  # by the first one dropped
    best, at = dropped[0][:, 0].copy(), np.zeros(rows, dtype=np.int64)
    tp, fn = np.arange(most + 1)[:, None], np.arange(most + 1)[None, :]
    for k in range(1, most + 1):
        kept = with_one(kept, p[:, k - 1])
        value = np.einsum("ri,rj,ij->r", kept, dropped[k], (1 + b2) * tp / (b2 * (tp + fn) + k))
        better = (value > best + 1e-15) & (k <= n)
        best[better], at[better] = value[better], k
    return at


def best_count(p: np.ndarray, beta: float = 0.5) -> int:
    """best_counts of one list of probabilities, the largest MOST of them."""
    p = np.sort(p)[::-1][:MOST]
    return int(best_counts(np.pad(p, (0, MOST - len(p)))[None, :], np.array([len(p)]), beta)[0])


@F.pandas_udf(T.LongType())
def _count_of(lists: pd.Series) -> pd.Series:
    n = lists.map(len).to_numpy()
    grid = np.zeros((len(n), MOST))
    grid[np.arange(MOST)[None, :] < n[:, None]] = np.concatenate([np.asarray(x, dtype=np.float64) for x in lists]) if n.sum() else []
    return pd.Series(best_counts(grid, n))


def expected_f05(owners: DataFrame, decoy_weight: float = 1.0) -> DataFrame:
    """(rid, s1, p, keep) of owners (rid, s1, p): the likeliest of each entity, as many as the expected F0.5 asks for.

    A false record weighs `decoy_weight`: p counts as p / (p + decoy_weight (1 - p)). Only MOST probabilities of an entity
    are gathered, whatever its size."""
    ranked = owners.select("rid", "s1", "p").withColumn("at", F.row_number().over(W.partitionBy("s1").orderBy(F.desc("p"), "rid")))
    weighed = F.col("p") / (F.col("p") + decoy_weight * (1 - F.col("p")))
    top = ranked.where(F.col("at") <= MOST).groupBy("s1").agg(F.array_sort(F.collect_list(F.struct("at", weighed.alias("w")))).alias("ps"))
    counts = top.select("s1", _count_of(F.col("ps.w")).alias("k"))
    return ranked.join(counts, "s1").select("rid", "s1", "p", (F.col("at") <= F.col("k")).alias("keep"))


# fixed values: what a proposal and a review of names and addresses leave out of account
PROPOSAL_LEGAL = ("sa", "sas", "sasu", "sarl", "eurl", "sci", "snc", "gmbh", "inc", "llc", "ltd", "pvt", "private", "limited", "llp", "lp", "corp", "co", "company", "plc", "pllc", "pc", "incorporated", "corporation")
PROPOSAL_ALIASES = ("formerly", "aka", "fka", "nee", "known", "as", "com", "www", "dba")
PROPOSAL_NOISE = (*PROPOSAL_LEGAL, *PROPOSAL_ALIASES, "de", "du", "des", "la", "le", "les", "et", "and", "the", "of", "d", "l", "a", "ms", "m", "s", "shri", "sri", "smt", "mr", "dr")
REVIEW_STOP = ("sa", "sas", "sasu", "sarl", "eurl", "sci", "snc", "ei", "eirl", "gmbh", "inc", "llc", "ltd", "pvt", "private", "limited", "llp", "lp", "corp", "co", "plc", "pllc", "pc", "incorporated", "corporation", "de", "du", "des", "la", "le", "les", "et", "and", "the", "of", "d", "l", "a", "ms", "shri", "sri", "smt", "mr", "dr", "m", "s")
BISTER = ("bis", "ter", "quater", "b", "t")
REVIEW_SKIP = ("bis", "ter", "b", "t", "ndeg")
REGION = r"\b(hauts de france|nouvelle aquitaine|pays de la loire|nord|gironde|loire atlantique|pas de calais)\b"
REVIEW_REGION = r"\b(hauts de france|nouvelle aquitaine|pays de la loire|loire atlantique|pas de calais|gironde|nord|france)\b"
DELTAS = (1, 2, 3, 4, 5, 7, 9, 11, 13, 21)
NOISE_WORDS = ("fils", "cie", "groupe", "services", "developpement", "associes", "france", "frs", "freres", "st", "compagnie", "et", "cb")

Classes = list[tuple]


def _matched_off(added: list[list[str]], removed: list[list[str]], least: float, prefixes: bool) -> list[bool]:
    """Take each added word off with the first removed word that it is alike to; both lists of every pair are changed in
    place. All ratios of a batch are computed at once. Returns whether any went."""
    left = [a for x, y in zip(added, removed, strict=True) for a in x for _ in y]
    right = [r for x, y in zip(added, removed, strict=True) for _ in x for r in y]
    alike = iter((sim.ratio(left, right) >= least).tolist() if left else ())
    out = []
    for x, y in zip(added, removed, strict=True):
        gone, kept = [False] * len(y), []
        for a in list(x):
            hits = [next(alike) or prefixes and len(a) >= 4 and len(r) >= 4 and (a.startswith(r) or r.startswith(a)) for r in y]
            j = next((j for j, h in enumerate(hits) if h and not gone[j]), None)
            if j is None:
                kept.append(a)
            else:
                gone[j] = True
        out.append(any(gone))
        x[:], y[:] = kept, [r for r, g in zip(y, gone, strict=True) if not g]
    return out


def _initials(words: list[str]) -> str:
    return "".join(w[0] for w in words)


def proposal_names(query: list[str], entity: list[str]) -> Classes:
    """(class, added, removed) of each pair of names: same, order, legal, spaceless, acronym, typo, add, rm or swap."""
    out, open_ = [], []
    for a, b in zip(query, entity, strict=True):
        qa, sa = a.split(), b.split()
        q, s = ([w for w in x if w not in PROPOSAL_NOISE and len(w) > 1] for x in (qa, sa))
        q = q or [w for w in qa if w not in PROPOSAL_LEGAL and w not in PROPOSAL_ALIASES]
        found = None
        if qa == sa or not q and not s:
            found = "same"
        elif set(q) == set(s):
            found = "order" if set(qa) == set(sa) else "legal"
        elif "".join(q) == "".join(s) or len(q) == 1 and len(s) >= 2 and "".join(s) in q[0]:
            found = "spaceless"
        elif len(q) == 1 and 2 <= len(q[0]) <= 6 and len(s) >= 2 and (_initials(s).startswith(q[0]) or q[0] == _initials([w for w in sa if w not in PROPOSAL_LEGAL])):
            found = "acronym"
        out.append((found, "", ""))
        if not found:
            open_.append((len(out) - 1, [w for w in q if w not in s], [w for w in s if w not in q], "".join(q), "".join(s)))
    typos = _matched_off([x[1] for x in open_], [x[2] for x in open_], 75, True)
    for (i, added, removed, qj, sj), typo in zip(open_, typos, strict=True):
        if added and not removed:
            added = [w for w in added if len(w) < 4 or w not in sj]
        elif removed and not added:
            removed = [w for w in removed if len(w) < 4 or w not in qj]
        kind = ("swap" if removed else "add") if added else "rm" if removed else "typo" if typo else "legal"
        out[i] = kind, " ".join(added), " ".join(removed)
    return out


def review_names(query: list[str], entity: list[str]) -> Classes:
    """(class, added, removed) of each pair of names: empty, eq, spaceless, acr, typo, disjoint, add, rm, swap1 or other."""
    out, open_ = [], []
    for a, b in zip(query, entity, strict=True):
        q, s = ([w for w in x.split() if w not in REVIEW_STOP and len(w) > 1] for x in (a, b))
        found = None
        if not q or not s:
            found = "empty"
        elif set(q) == set(s):
            found = "eq"
        elif "".join(q) == "".join(s):
            found = "spaceless"
        elif len(q) == 1 and 2 <= len(q[0]) <= 5 and len(s) >= 2 and q[0] in (_initials(s), _initials(b.split())):
            found = "acr"
        out.append((found, "", ""))
        if not found:
            open_.append((len(out) - 1, sorted(set(q) - set(s)), sorted(set(s) - set(q)), bool(set(q) & set(s))))
    typos = _matched_off([x[1] for x in open_], [x[2] for x in open_], 80, False)
    for (i, added, removed, common), typo in zip(open_, typos, strict=True):
        if not added and not removed:
            kind = "typo"
        elif not common and not typo:
            kind = "disjoint"
        elif not removed or not added:
            kind = "add" if added else "rm"
        else:
            kind = "swap1" if len(added) == len(removed) == 1 else "other"
        out[i] = kind, " ".join(added), " ".join(removed)
    return out


def _alike_words(pairs: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """Whether the sorted words of both sides have a ratio of 85 or more."""
    return sim.ratio([" ".join(sorted(a)) for a, _ in pairs], [" ".join(sorted(b)) for _, b in pairs]) >= 85


def proposal_addresses(query: list[str], entity: list[str]) -> Classes:
    """(class, delta) of each pair of addresses: missing, s_missing, same, region, bister, subset, typo, street,
    num_dropped, num_added, num_partial, num_change or other; delta is how far the first numbers are apart."""
    import re

    region, sides = re.compile(REGION), []
    for a, b in zip(query, entity, strict=True):
        row = []
        for x in (a, b):
            t = region.sub(" ", x).split()
            row.append((sorted(t), [w for w in t if w.isdigit()], sorted(w for w in t if not w.isdigit() and w not in BISTER), sorted(w for w in t if w in BISTER)))
        sides.append(row)
    alike, out = _alike_words([(q[2], s[2]) for q, s in sides]), []
    for a, b, ((q, qn, qw, qb), (s, sn, sw, sb)), near in zip(query, entity, sides, alike.tolist(), strict=True):
        delta = int(qn[0]) - int(sn[0]) if qn and sn and qn[0] != sn[0] else None
        if not a or not b:
            out.append(("s_missing" if a else "missing", None))
        elif sorted(a.split()) == sorted(b.split()):
            out.append(("same", None))
        elif q == s:
            out.append(("region", None))
        elif sorted(qn) == sorted(sn):
            inside = set(qw) <= set(sw) or set(sw) <= set(qw)
            out.append((("same" if qb == sb else "bister") if qw == sw else "subset" if inside else "typo" if near else "street", None))
        elif not qn or not sn:
            out.append(("other" if not near else "num_added" if qn else "num_dropped", None))
        else:
            out.append(("other" if not near else "num_partial" if set(qn) & set(sn) else "num_change", delta))
    return out


def review_addresses(query: list[str], entity: list[str]) -> Classes:
    """(class, delta) of each pair of address keys: missing, s_missing, same, same_ns, numdrop, numchg1, numchg,
    same_num_wtypo, street, numchg1_wtypo or other."""
    sides = [[([w for w in x.split() if w.isdigit()], sorted(w for w in x.split() if not w.isdigit() and w not in REVIEW_SKIP)) for x in both] for both in zip(query, entity, strict=True)]
    alike, out = _alike_words([(q[1], s[1]) for q, s in sides]), []
    for a, b, ((qn, qw), (sn, sw)), near in zip(query, entity, sides, alike.tolist(), strict=True):
        one, equal = len(qn) == len(sn) == 1, sorted(qn) == sorted(sn)
        delta = int(qn[0]) - int(sn[0]) if one else None
        if not a or not b:
            out.append(("s_missing" if a else "missing", None))
        elif a == b:
            out.append(("same", None))
        elif qw == sw:
            kind = "same_ns" if equal else "numdrop" if sn and not qn else "numchg1" if one else "numchg"
            out.append((kind, delta if kind == "numchg1" else None))
        elif equal and qn:
            out.append(("same_num_wtypo" if near else "street", None))
        elif one and near:
            out.append(("numchg1_wtypo", delta))
        else:
            out.append(("other", None))
    return out


def _classifier(f: Callable, fields: dict[str, T.DataType]):
    """f over the distinct pairs of a batch; a null text counts as empty."""

    @F.pandas_udf(T.StructType([T.StructField(n, t) for n, t in fields.items()]))
    def classify(query: pd.Series, entity: pd.Series) -> pd.DataFrame:
        codes, left, right = sim.distinct_pairs(query.fillna(""), entity.fillna(""))
        found = pd.DataFrame(f(left, right), columns=list(fields)).astype(object)
        out = found.iloc[codes].reset_index(drop=True)
        return out.astype({n: "Int64" for n, t in fields.items() if isinstance(t, T.LongType)})

    return classify


_NAME, _ADDRESS = {"name_class": T.StringType(), "added": T.StringType(), "removed": T.StringType()}, {"address_class": T.StringType(), "delta": T.LongType()}
proposal_name, proposal_address = _classifier(proposal_names, _NAME), _classifier(proposal_addresses, _ADDRESS)
review_name, review_address = _classifier(review_names, _NAME), _classifier(review_addresses, _ADDRESS)


def address_key(address: Column, region: str = REVIEW_REGION, split_suffix: bool = True) -> Column:
    """The words of an address in order, without region names, number suffixes apart."""
    text = F.regexp_replace(F.coalesce(address, F.lit("")), region, " ")
    text = F.regexp_replace(text, r"\b([0-9]+)(bis|ter|[a-df-z])\b", "$1 $2") if split_suffix else text
    return F.array_join(F.array_sort(F.filter(F.split(text, " "), lambda w: (w != "") & (w != "ndeg"))), " ")


def verdict(name_class: Column, added: Column, removed: Column, address_class: Column, delta: Column) -> Column:
    """same, same_noise, diff_addr, diff_typeswap, or unsure_... where the classes don't settle it."""
    same_name = name_class.isin("eq", "typo", "spaceless", "acr")
    same_address = address_class.isin("same", "same_ns", "same_num_wtypo", "missing", "s_missing", "numdrop")
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != "")
    new = F.exists(words(added), lambda w: ~w.isin(*NOISE_WORDS))
    changed = name_class.isin("add", "swap1", "other", "rm")
    odd_step = same_name & address_class.isin("numchg1", "numchg1_wtypo") & delta.isNotNull() & ~F.abs(delta).isin(*DELTAS)
    return (
        F.when(address_class.isin("numchg1", "numchg1_wtypo", "numchg", "street"), F.when(odd_step, "unsure_num").otherwise("diff_addr"))
        .when(same_name, F.when(same_address, "same").otherwise("unsure_addr"))
        .when(changed & new, F.when(F.size(words(removed)) > 0, "diff_typeswap").otherwise("unsure_addword"))
        .when(changed, F.when(same_address, "same_noise").otherwise("unsure_addr"))
        .otherwise(F.concat(F.lit("unsure_"), name_class))
    )


def reviewed(pairs: DataFrame) -> DataFrame:
    """pairs with the review classes of q_name_full and s_name_full and of both address keys, and the verdict."""
    keys = [address_key(F.col(f"{k}_address")) for k in "qs"]
    found = pairs.withColumns({"n": review_name("q_name_full", "s_name_full"), "a": review_address(*keys)})
    return found.select(*pairs.columns, "n.*", "a.*").withColumn("verdict", verdict(*(F.col(c) for c in ("name_class", "added", "removed", "address_class", "delta"))))


#: Pairs that a word must come with to be a decoy, or a replacement, and the share of true pairs that it may have.
LEAST_DECOYS, LEAST_REPLACEMENTS, TRUE_SHARE = 200, 20, 0.002


def _listed(words: DataFrame, least: int, share: float) -> DataFrame:
    """(country, w, decoy_n, true_n) of words (country, w, is_true) that come with decoys and hardly with true pairs."""
    counted = words.groupBy("country", "w").agg(F.count_if(~F.col("is_true")).alias("decoy_n"), F.count_if("is_true").alias("true_n"))
    return counted.where((F.col("decoy_n") >= least) & (F.col("true_n") <= share * F.col("decoy_n")))


def first_pairs(cand: DataFrame, truth: DataFrame, qt: DataFrame, st: DataFrame, held_out: int = 20) -> DataFrame:
    """Pairs at rank 1 outside the held-out slice of entities, whose record is the entity's or nobody's."""
    top = cand.where((F.col("rk") == 1) & (F.col("s1") % held_out != 0)).select("rid", "s1")
    labelled = top.join(truth.withColumnRenamed("s1", "owner"), "rid", "left").where(F.col("owner").isNull() | (F.col("owner") == F.col("s1")))
    return features.with_texts(labelled.withColumn("is_true", F.col("owner").isNotNull()).drop("owner"), qt, st).withColumnRenamed("q_country", "country")


def decoy_words(first: DataFrame, least: int = LEAST_DECOYS, share: float = TRUE_SHARE) -> DataFrame:
    """Words that records add to an otherwise complete name and that hardly ever come with a true pair, by country."""
    full = lambda k: F.filter(F.split(f"{k}_name_full", " "), lambda w: (F.length(w) >= 3) & w.rlike("^[a-z]+$"))
    whole = F.size(F.array_except("s_name_words", F.split("q_name_full", " "))) == 0
    extra = first.where(whole & (F.size("s_name_words") > 0)).select("country", "is_true", F.explode(F.array_except(full("q"), full("s"))).alias("w"))
    return _listed(extra, least, share)


#: Words of legal forms and stop words that stand for no replacement.
_UNSAID = (*features.LEGAL_WORDS, "the", "and", "of", "et", "de", "du", "des", "la", "le", "les", "ms", "m", "s", "shri", "sri", "dba", "formerly", "known", "as", "com", "www", "d", "l", "a")


def new_words(query: list[str], entity: list[str]) -> list[list[str]]:
    """Words of each query name without a counterpart in the entity's: the same word, a part of its words run together,
    two of its words inside, or one alike at 75 or more that the query lacks."""
    open_, left, right = [], [], []
    for a, b in zip(query, entity, strict=True):
        q, s = ([w for w in x.split() if w not in _UNSAID] for x in (a, b))
        joined, rest = "".join(s), [w for w in s if w not in q]
        some = [w for w in q if w not in s and not (len(w) >= 4 and w in joined) and not (len(w) >= 6 and sum(len(o) >= 3 and o in w for o in s) >= 2)]
        open_.append([(w, len(left) + i * len(rest), len(left) + (i + 1) * len(rest)) for i, w in enumerate(some)])
        left += [w for w in some for _ in rest]
        right += rest * len(some)
    near = np.concatenate([[0], np.cumsum(sim.ratio(left, right) >= 75)]) if left else np.zeros(1, dtype=np.int64)
    return [[w for w, a, b in some if near[a] == near[b]] for some in open_]


@F.pandas_udf(T.ArrayType(T.StringType()))
def new_words_of(query: pd.Series, entity: pd.Series) -> pd.Series:
    codes, left, right = sim.distinct_pairs(query.fillna(""), entity.fillna(""))
    found = new_words(left, right)
    return pd.Series([found[c] for c in codes])


def by_country(words: DataFrame) -> DataFrame:
    """(country, words): the listed words of a country as one array."""
    return words.groupBy("country").agg(F.array_sort(F.collect_list("w")).alias("words"))


def replacement_words(first: DataFrame, decoys: DataFrame, least: int = LEAST_REPLACEMENTS, share: float = TRUE_SHARE) -> DataFrame:
    """Words that stand in a record for another word and hardly ever come with a true pair, by country; pairs that a decoy
    word settles are left out."""
    known = first.join(by_country(decoys).withColumnRenamed("words", "decoys"), "country", "left")
    settled = F.size(F.array_intersect(F.array_except(F.split("q_name_full", " "), F.split("s_name_full", " ")), F.coalesce("decoys", F.array().cast("array<string>")))) > 0
    extra = known.where(~settled).select("country", "is_true", F.explode(F.array_distinct(new_words_of("q_name_full", "s_name_full"))).alias("w"))
    return _listed(extra.where(F.length("w") >= 3), least, share)


def vetoed(owners: DataFrame, words: DataFrame) -> Column:
    """Whether a listed decoy word of the country stands in the record's name and not in the entity's (columns of
    features.with_texts, and `words`)."""
    lettered = F.filter(F.split("q_name_full", " "), lambda w: (F.length(w) >= 3) & w.rlike("^[a-z]+$"))
    return F.size(F.array_intersect(F.array_except(lettered, F.split("s_name_full", " ")), F.coalesce("words", F.array().cast("array<string>")))) > 0


# fixed values: words that no name is told apart by
SWAP_NOISE = ("pvt", "private", "ltd", "limited", "llp", "llc", "inc", "incorporated", "corp", "corporation", "co", "company", "lp", "plc", "pllc", "pc", "sarl", "sas", "sasu", "eurl", "sa", "sci", "snc", "cie", "fils", "et", "and", "the", "of", "de", "du", "des", "la", "le", "les", "associes", "ei", "services", "service", "center", "centre", "shri", "sri", "ms", "formerly", "known", "as", "dba", "com", "www")
#: A word is frequent from so many entities of a country on; a swap veto holds below this probability.
VOCABULARY, SWAP_P, SWAP_RATIO = 50, 0.99, 70


@F.pandas_udf(T.BooleanType())
def _apart(words: pd.Series, others: pd.Series) -> pd.Series:
    """Whether any of the words is neither inside nor alike to the other name's."""
    left, right, owner, inside = [], [], [], np.zeros(len(words), dtype=np.int64)
    flat: list[tuple[int, int, int]] = []
    for i, (x, y) in enumerate(zip(words, others, strict=True)):
        joined = "".join(y)
        for w in x:
            if w not in joined:
                flat.append((i, len(left), len(left) + len(y)))
                left += [w] * len(y)
                right += list(y)
    near = np.concatenate([[0], np.cumsum(sim.ratio(left, right) >= SWAP_RATIO)]) if left else np.zeros(1, dtype=np.int64)
    for i, a, b in flat:
        inside[i] |= near[a] == near[b]
    return pd.Series(inside.astype(bool))


def swapped(owners: DataFrame, entities: DataFrame, least: int = VOCABULARY) -> DataFrame:
    """Owners (with texts) whose name has a frequent word that the entity's lacks, and lacks a frequent word of it."""
    df = entities.select("country", F.explode(F.array_distinct(F.split("name_full", " "))).alias("w")).groupBy("country", "w").count().where(F.col("count") >= least)
    d = owners.where(F.col("p") < SWAP_P).withColumns({"qw": F.split("q_name_full", " "), "sw": F.split("s_name_full", " ")})

    def frequent(a: str, b: str, name: str) -> DataFrame:
        each = d.select("rid", "s1", F.col("q_country").alias("country"), F.explode(F.array_except(a, b)).alias("w")).where(F.col("w").rlike("^[a-z]{3,}$") & ~F.col("w").isin(*SWAP_NOISE))
        return each.join(df, ["country", "w"], "left_semi").groupBy("rid", "s1").agg(F.collect_set("w").alias(name))

    both = d.join(frequent("qw", "sw", "added"), ["rid", "s1"]).join(frequent("sw", "qw", "lost"), ["rid", "s1"])
    return both.where(_apart("added", "sw") & _apart("lost", "qw")).drop("qw", "sw")


# fixed values: words of trade that are no type of business
TRADE_WORDS = ("fils", "cie", "compagnie", "associes", "groupe", "developpement", "frs", "freres", "st", "saint", "ste", "sainte", "ets", "etablissements", "societe", "partners", "id", "lnc")


def type_words(entities: DataFrame, share: float = 0.005) -> DataFrame:
    """(country, w, n): words that stand in this share of a country's names and of fewer of its addresses."""
    total = entities.groupBy("country").agg((share * F.count("*")).alias("floor"))
    held = lambda col, n: entities.select("country", F.explode(F.array_distinct(F.split(col, " "))).alias("w")).groupBy("country", "w").agg(F.count("*").alias(n))
    both = held("name_core", "n").join(held("address", "at"), ["country", "w"], "left").join(total, "country")
    return both.where((F.col("n") >= F.col("floor")) & (F.coalesce("at", F.lit(0)) < F.col("floor")) & F.col("w").rlike("^[a-z]{3,}$") & ~F.col("w").isin(*TRADE_WORDS)).select("country", "w", "n")


def type_swaps(pairs: DataFrame, types: DataFrame) -> DataFrame:
    """Pairs (with texts) whose record adds one type word and lacks at most one word, not alike to it."""
    q, s = F.split("q_name_core", " "), F.split("s_name_core", " ")
    d = pairs.withColumns({"added": F.array_except(q, s), "lost": F.array_except(s, q)}).where((F.size("added") == 1) & (F.size("lost") <= 1))
    d = d.withColumns({"new": F.get("added", F.lit(0)), "old": F.get("lost", F.lit(0))})
    d = d.join(types.select(F.col("country").alias("q_country"), F.col("w").alias("new")), ["q_country", "new"], "left_semi")
    return d.where(F.col("old").isNull() | (sim.UDFS["jaro_winkler"]("new", "old") < 0.75)).drop("added", "lost")
