"""Linkage fixtures over the synthetic tables: a clean registry of parts, noisy copies and decoys with known truth.

Everything is arithmetic on keys, so that any engine builds the same rows."""

from __future__ import annotations

from erloom.plans.dialect import Spark

#: House-number shifts of decoys (fixed values).
SHIFTS = (3, 4, 5, 7, 9, 11, 13, 21)
#: Perturbation classes by part key modulo 12 whose owner is the part itself; the others are decoys.
TRUE_CLASSES = (0, 1, 2, 3, 4, 5, 6, 10)
#: Words of legal forms and the code of the form that they stand for.
LEGAL_CODES = {
    "pvt": "pvtltd",
    "private": "pvtltd",
    "ltd": "pvtltd",
    "limited": "pvtltd",
    "llp": "llp",
    "llc": "llc",
    "inc": "inc",
    "incorporated": "inc",
    "corp": "corp",
    "corporation": "corp",
    "co": "co",
    "company": "co",
    "lp": "lp",
    "plc": "plc",
    "pllc": "pllc",
    "pc": "pc",
    "sarl": "sarl",
    "sas": "sas",
    "sasu": "sasu",
    "eurl": "eurl",
    "sa": "sa",
    "snc": "snc",
    "sci": "sci",
}


def registry(d: Spark) -> str:
    """Common table expressions: base, s1 (the registry), q (noisy records), truth."""
    if d.store:
        return ",\n".join(d.store.cte(name) for name in ("base", "s1", "q", "truth"))
    pick = lambda s, i: f"substr('{s}', cast({i} as int) + 1, 1)"
    word = f"concat({pick('bcdfghklmnprstvz', 'k % 16')}, {pick('aeiou', 'k % 5')}, {pick('lmnrst', d.div('k', 7) + ' % 6')}, 'o', {pick('bcdfghklmnprstvz', d.div('k', 16) + ' % 16')}, {pick('aeiou', d.div('k', 11) + ' % 5')})"
    shift = f"CASE k % 8 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(SHIFTS))} END"
    w = d.words("nm")
    return f"""
base AS (SELECT k, country, house, brand, sz, concat(nm0, ' ', {word}) AS nm, CASE k % 4 WHEN 0 THEN 'pvt ltd' WHEN 1 THEN 'inc' WHEN 2 THEN 'llc' ELSE 'corp' END AS form
  FROM (SELECT cast(p_partkey as bigint) AS k, p_type AS country, lower(p_name) AS nm0, (cast(p_partkey as bigint) * 7919) % 9973 + 1 AS house, lower(replace(p_brand, '#', ' ')) AS brand, cast(p_size as varchar(9)) AS sz FROM {d.t('part')}) b0),
s1 AS (SELECT 10000000000 + k AS eid, k, country, nm AS name_core, concat(nm, ' ', form) AS name_full, concat(cast(house as varchar(9)), ' ', brand, ' st ', sz) AS address FROM base),
q AS (SELECT (2 + k % 2) * 10000000000 + k AS eid, k, country, cls, name_core, CASE WHEN cls = 5 THEN concat(name_core, ' llc') ELSE concat(name_core, ' ', form) END AS name_full, address
  FROM (SELECT *, CASE cls WHEN 1 THEN concat({d.at(w, 3)}, ' ', {d.at(w, 2)}, ' ', {d.at(w, 1)}) WHEN 2 THEN concat({d.at(w, 1)}, {d.at(w, 2)}, ' ', {d.at(w, 3)}) WHEN 3 THEN concat(substr(nm, 1, 2), substr(nm, 4))
      WHEN 4 THEN concat({d.at(w, 2)}, ' ', {d.at(w, 3)}) WHEN 7 THEN concat(nm, ' outlet') WHEN 10 THEN concat(substr({d.at(w, 1)}, 1, 1), substr({d.at(w, 2)}, 1, 1), substr({d.at(w, 3)}, 1, 1)) WHEN 11 THEN concat({d.at(w, 1)}, ' ', {d.at(w, 3)}, ' studio') ELSE nm END AS name_core,
    CASE WHEN cls = 6 THEN '' ELSE concat(cast(house + CASE cls WHEN 8 THEN {shift} WHEN 9 THEN 100 ELSE 0 END as varchar(9)), ' ', brand, ' st ', sz) END AS address
    FROM (SELECT *, k % 12 AS cls FROM base) b1) b2),
truth AS (SELECT eid AS rid, 10000000000 + k AS s1 FROM q WHERE cls IN {TRUE_CLASSES})"""


def texts(d: Spark, alias: str, source: str) -> str:
    """A CTE of `source` with what keys and features are made of: the words of two letters or more of the core name and
    of the address, the whole numbers of the address, and the codes of the legal forms in the full name.

    Spark reads the tables that `erloom.operators.features.tokens` makes; this is the text of the other engine."""
    if d.store:
        return d.store.cte(alias)
    codes = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LEGAL_CODES.items()) + "}"
    some = lambda col: f"list_filter(string_split({col}, ' '), lambda w: len(w) > 1)"
    return f"""{alias} AS (SELECT *, {some('name_core')} AS name_words, {some('address')} AS address_words, list_filter(regexp_split_to_array(address, '[^0-9A-Za-z_]+'), lambda w: regexp_full_match(w, '[0-9]+')) AS numbers,
  list_distinct(list_filter(list_transform(string_split(name_full, ' '), lambda w: ({codes})[w]), lambda c: c IS NOT NULL)) AS forms FROM {source})"""
