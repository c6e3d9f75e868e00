"""Second-chance candidates for records that blocking left without an owner: key families, gates, selection."""

from __future__ import annotations


from erloom.sources.fixtures import registry, texts

from .registry import dual, scored, with_

#: Longest name, in words, whose subsets are enumerated.
SUBSET_WORDS = 7


def _base(d) -> list[str]:
    return [registry(d), texts(d, "st", "s1"), texts(d, "qt", "q")]


def letters(d, text: str) -> str:
    return d.joined(d.ordered(d.chars(f"replace({text}, ' ', '')")), "")


def _keys(d, kind: str, source: str) -> str:
    """(eid, country, k) of one family."""
    num, rest = d.at("numbers", 1), d.flt("address_words", "x", "NOT " + d.like("x", "^[0-9]+$"))
    if kind == "aexact":
        return f"SELECT eid, country, address AS k FROM {source} WHERE {d.n('numbers')} > 0 AND address <> ''"
    if kind == "corenum":
        return f"SELECT eid, country, concat({d.joined(d.ordered(d.distinct('name_words')))}, '#', {num}) AS k FROM {source} WHERE {d.n('numbers')} > 0"
    if kind == "anum":
        return f"SELECT DISTINCT eid, country, concat(n, '|', w) AS k FROM (SELECT eid, country, {num} AS n, {d.rows(rest)} AS w FROM {source} WHERE {d.n('numbers')} > 0) x"
    if kind == "anumt":
        return f"SELECT DISTINCT eid, country, concat(n, '|', w) AS k FROM (SELECT eid, country, {d.rows(d.arr('substr(n0, 2)', 'substr(n0, 1, length(n0) - 1)'))} AS n, w FROM (SELECT eid, country, {num} AS n0, {d.rows(rest)} AS w FROM {source} WHERE {d.n('numbers')} > 0) x) y WHERE n <> ''"
    if kind == "aalpha":
        return f"SELECT eid, country, {d.joined(d.ordered(d.distinct(rest)))} AS k FROM {source} WHERE {d.n(rest)} >= 2"
    if kind == "cat":
        sub = d.each2("name_words", "x", "i", d.bit("m", "{i} - 1" if d.name == "duck" else "cast({i} - 1 as int)"))
        return f"SELECT DISTINCT eid, country, {letters(d, d.joined(sub))} AS k FROM (SELECT eid, country, name_words, {d.rows(d.upto('cast(power(2, ' + d.n('name_words') + ') as bigint) - 1'))} AS m FROM {source} WHERE {d.n('name_words')} <= {SUBSET_WORDS}) x WHERE length({d.joined(sub)}) >= 5"
    if kind == "ini":
        one = f"SELECT eid, country, name_words, {d.at('name_words', 'i')} AS w, i FROM (SELECT eid, country, name_words, {d.rows(d.upto(d.n('name_words')))} AS i FROM {source}) x"
        other = f"SELECT eid, country, w, {d.at('name_words', 'j')} AS o FROM (SELECT *, {d.rows(d.upto(d.n('name_words')))} AS j FROM ({one}) y) z WHERE j <> i AND length(w) >= 3"
        return f"SELECT DISTINCT eid, country, {letters(d, 'concat(w, substr(o, 1, 1))')} AS k FROM ({other}) v"
    raise ValueError(kind)


def _family(kind: str):
    def build(d):
        return with_(d, *_base(d)) + _keys(d, kind, "st")

    build.__name__ = f"keys_{kind}"
    return dual(build)


for _kind in ("aexact", "corenum", "anum", "anumt", "aalpha", "cat", "ini"):
    globals()[f"keys_{_kind}"] = _family(_kind)


@dual
def keys_typo(d):
    """Letters of a word short of one, anchored at another word of the name; words of a record must be unknown to the registry."""
    w = f"SELECT eid, country, name_words, {d.at('name_words', 'i')} AS a, i FROM (SELECT eid, country, name_words, {d.rows(d.upto(d.n('name_words')))} AS i FROM qt) x"
    cut = f"SELECT *, {d.rows(d.upto('length(a)'))} AS j FROM w WHERE length(a) >= 4 AND NOT EXISTS (SELECT 1 FROM vocab v WHERE v.w = a)"
    return with_(d, *_base(d), f"vocab AS (SELECT DISTINCT w FROM (SELECT {d.rows('name_words')} AS w FROM st) v)", f"w AS ({w})", f"c AS ({cut})") + f"SELECT DISTINCT c.eid, concat(o.a, '|', {letters(d, 'concat(substr(c.a, 1, cast(c.j as int) - 1), substr(c.a, cast(c.j as int) + 1))')}) AS k FROM c JOIN w o ON o.eid = c.eid AND o.i <> c.i"


@dual
def oov_gate(d):
    """Records without an owner that have a word of three or more letters which the registry doesn't know."""
    anti = "LEFT ANTI" if d.name == "spark" else "ANTI"
    return with_(d, scored(d), "free AS (SELECT * FROM qt WHERE NOT EXISTS (SELECT 1 FROM scored c WHERE c.rid = qt.eid AND c.p >= 0.5))", f"vocab AS (SELECT DISTINCT w FROM (SELECT {d.rows('name_words')} AS w FROM st) v)", f"words AS (SELECT DISTINCT eid, w FROM (SELECT eid, {d.rows('name_words')} AS w FROM free) x WHERE length(w) >= 3)") + f"SELECT eid, count(*) AS unknown FROM words {anti} JOIN vocab v ON v.w = words.w GROUP BY eid"


@dual
def synthetic_pairs(d):
    """Training pairs by known perturbation, labelled, in a hashed order."""
    h = d.md5n("cast(q.eid as varchar(12))")
    return with_(d, registry(d)) + f"SELECT q.eid AS rid, s1.eid AS s1, q.cls, CASE WHEN t.rid IS NULL THEN 0 ELSE 1 END AS label, cast(row_number() OVER (PARTITION BY q.cls ORDER BY {h}, q.eid) as bigint) AS i FROM q JOIN s1 ON s1.k = q.k LEFT JOIN truth t ON t.rid = q.eid"
