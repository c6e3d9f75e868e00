"""Training pairs from clean entities by known changes: noise that keeps the owner, and changes that make a decoy.

What is changed, and how, follows from a hash of the id, so that rows come out the same wherever they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import SHIFTS

#: Changes that make another business, and changes that leave it the same.
DECOYS = ("typeswap", "shift", "legal", "addword")
COPIES = ("typo", "drop", "suffix", "legaldrop", "ndeg", "citymove", "noaddr", "typesuffix", "glue", "acronym", "numdrop")
# fixed values: words that changes bring in
TYPES = ("bakery", "garage", "studio", "pharmacy", "garden", "logistics", "clinic", "market")
FORMS = ("sarl", "sas", "ltd", "inc", "llc")
#: Copies whose label is turned to noise, in a thousand.
FLIPPED = 20


def _pick(salt: int, n: int) -> Column:
    return F.pmod(F.xxhash64("eid", "change", F.lit(salt)), F.lit(n))


def _one_of(words: tuple[str, ...], salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (_pick(salt, len(words)) + 1).cast("int"))


def generated(entities: DataFrame, changes: tuple[str, ...] = (*DECOYS, *COPIES)) -> DataFrame:
    """(s1, change, name, address, label) of entities (eid, name_full, address): each with one of the changes, picked by a
    hash. A change that a text leaves no room for leaves it as it is. Labels of a few copies are turned, as in real rows."""
    names = F.array(*map(F.lit, changes))
    d = entities.select("eid", "name_full", "address", F.element_at(names, (F.pmod(F.xxhash64("eid", F.lit(77)), F.lit(len(changes))) + 1).cast("int")).alias("change"))
    words, parts = F.split("name_full", " "), F.split("address", " ")
    n, at = F.size(words), _pick(1, 1 << 20)
    place = (at % F.greatest(n, F.lit(1))).cast("int")
    joined = lambda a, by=" ": F.array_join(a, by)
    without = lambda i: F.filter(words, lambda w, j: j != i)
    first, number = F.get(words, F.lit(0)), F.regexp_extract("address", "^([0-9]+)", 1)
    long = F.get(words, place)
    cut = (at % F.greatest(F.length(long), F.lit(1))).cast("int") + 1
    shifted = F.when(number != "", F.concat((number.cast("long") + F.element_at(F.array(*map(F.lit, SHIFTS)), (_pick(2, len(SHIFTS)) + 1).cast("int"))).cast("string"), F.regexp_replace("address", "^[0-9]+", "")))
    name = {
        "typeswap": joined(F.transform(words, lambda w, i: F.when(i == n - 1, _one_of(TYPES, 3)).otherwise(w))),
        "addword": F.concat("name_full", F.lit(" "), _one_of(TYPES, 3)),
        "legal": joined(F.concat(F.filter(words, lambda w: ~w.isin(*FORMS)), F.array(_one_of(FORMS, 4)))),
        "typo": joined(F.transform(words, lambda w, i: F.when((i == place) & (F.length(w) > 3), F.concat(w.substr(F.lit(1), cut - 1), w.substr(cut + 1, F.length(w)))).otherwise(w))),
        "drop": F.when(n > 2, joined(without(place))),
        "suffix": F.concat("name_full", F.lit(" "), _one_of(FORMS, 4)),
        "legaldrop": joined(F.filter(words, lambda w: ~w.isin(*FORMS))),
        "typesuffix": F.concat("name_full", F.lit(" et cie")),
        "glue": F.concat(first, joined(F.filter(words, lambda w, i: i > 0))),
        "acronym": F.when(n > 2, joined(F.transform(words, lambda w: F.substring(w, 1, 1)), "")),
    }
    address = {
        "shift": shifted,
        "ndeg": F.when(number != "", F.concat(F.lit("ndeg "), F.col("address"))),
        "citymove": joined(F.concat(F.filter(parts, lambda p, i: i > 0), F.array(F.get(parts, F.lit(0))))),
        "noaddr": F.lit(""),
        "numdrop": F.regexp_replace("address", "^[0-9]+ ", ""),
    }

    def chosen(cases: dict[str, Column], plain: str) -> Column:
        out = F.col(plain)
        for change, value in cases.items():
            out = F.when(F.col("change") == change, F.coalesce(value, F.col(plain))).otherwise(out)
        return out

    copy = ~F.col("change").isin(*DECOYS)
    label = copy & ~(_pick(5, 1000) < FLIPPED)
    return d.select(F.col("eid").alias("s1"), "change", chosen(name, "name_full").alias("name"), chosen(address, "address").alias("address"), label.cast("int").alias("label"))
