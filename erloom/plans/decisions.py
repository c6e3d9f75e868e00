"""From scores to an assignment: context features, siblings, owners, vetoes, additions, change sets."""

from __future__ import annotations

from erloom.sources.fixtures import SHIFTS, registry, texts

from .registry import dual, scored, with_


def _siblings(d) -> str:
    """Best entity of each record, and numbers of both sides."""
    first = lambda t: f"try_cast({d.at(t + '.numbers', 1)} as bigint)"
    return f"""best AS (SELECT rid, s1, p FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p DESC, s1) AS r FROM scored) z WHERE r = 1),
pairs AS (SELECT c.rid, c.s1, c.p, {d.div('c.rid', 10000000000)} AS source, {first('q')} AS qn, {first('s')} AS sn, CASE WHEN {first('q')} IS NULL OR {first('s')} IS NULL THEN NULL WHEN {first('q')} = {first('s')} THEN 1 ELSE 0 END AS fne FROM scored c JOIN qt q ON q.eid = c.rid JOIN st s ON s.eid = c.s1)"""


@dual
def sibling_counts(d):
    """Other records whose best entity is this one, sure enough, from either source."""
    return with_(d, scored(d), _siblings(d)) + "SELECT c.rid, c.s1, count(b.rid) AS n5, count(CASE WHEN b.p >= 0.9 THEN 1 END) AS n9, count(CASE WHEN b.p >= 0.9 AND b.rid % 2 <> c.rid % 2 THEN 1 END) AS n9_x FROM scored c LEFT JOIN best b ON b.s1 = c.s1 AND b.rid <> c.rid AND b.p >= 0.5 GROUP BY c.rid, c.s1"


@dual
def odd_numbers(d):
    """How a pair's house number differs, and whether siblings agree with the record's or the entity's number."""
    return with_(d, scored(d), _siblings(d), "sib AS (SELECT b.s1, b.rid, x.qn FROM best b JOIN pairs x ON x.rid = b.rid AND x.s1 = b.s1 WHERE b.p >= 0.5)") + f"""SELECT a.rid, a.s1, greatest(least(a.qn - a.sn, 100), -100) AS d1, CASE WHEN a.qn IS NULL OR a.sn IS NULL THEN NULL WHEN a.qn = a.sn THEN 0 WHEN a.qn - a.sn IN {SHIFTS} THEN 1 WHEN a.qn - a.sn IN (1, 2) THEN 2 WHEN a.qn - a.sn IN (-1, -2, -3) THEN 3 ELSE 4 END AS d1_cls,
  count(CASE WHEN s.qn = a.qn THEN 1 END) AS q1_sib, count(CASE WHEN s.qn = a.sn THEN 1 END) AS s1_sib FROM pairs a LEFT JOIN sib s ON s.s1 = a.s1 AND s.rid <> a.rid GROUP BY a.rid, a.s1, a.qn, a.sn"""


@dual
def odd_words(d):
    """Words that a record adds to and drops from its entity's name, and how many siblings back them."""
    return with_(d, scored(d), "best AS (SELECT rid, s1, p FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p DESC, s1) AS r FROM scored) z WHERE r = 1 AND p >= 0.5)", f"diff AS (SELECT c.rid, c.s1, {d.less('q.name_words', 's.name_words')} AS added, {d.less('s.name_words', 'q.name_words')} AS removed FROM scored c JOIN qt q ON q.eid = c.rid JOIN st s ON s.eid = c.s1)", f"word AS (SELECT rid, s1, {d.rows('added')} AS w FROM diff)", f"sibword AS (SELECT b.rid, b.s1, {d.rows('q.name_words')} AS w FROM best b JOIN qt q ON q.eid = b.rid)", "backed AS (SELECT w.rid, w.s1, count(DISTINCT w.w) AS n FROM word w JOIN sibword s ON s.s1 = w.s1 AND s.w = w.w AND s.rid <> w.rid GROUP BY w.rid, w.s1)") + f"SELECT f.rid, f.s1, {d.n('f.added')} AS add_n, {d.n('f.added')} - coalesce(b.n, 0) AS add_unsup, {d.n('f.removed')} AS rem_n FROM diff f LEFT JOIN backed b ON b.rid = f.rid AND b.s1 = f.s1"


def _owner(d) -> str:
    return "best AS (SELECT rid, s1, p FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p DESC, s1) AS r FROM scored) z WHERE r = 1 AND p >= 0.01)"


@dual
def best_owner(d):
    """At most one owner for each record: the likeliest, the smaller id where two are as likely."""
    return with_(d, scored(d)) + f"SELECT rid, {d.best('s1', 'p', '-s1')} AS s1, max(p) AS p FROM scored GROUP BY rid HAVING max(p) >= 0.01"


@dual
def guard_min(d):
    """Two models must name the same owner; then the lower probability holds, else none."""
    return with_(d, scored(d), f"g AS (SELECT rid, s1, p, cast((rid * 31 + s1 * 17) % 1000 as double) / 1000 AS g FROM scored)", f"a AS (SELECT rid, {d.best('s1', 'p', '-s1')} AS s1, max(p) AS p, {d.best('s1', 'g', '-s1')} AS g_s1, max(g) AS gp FROM g GROUP BY rid)") + "SELECT rid, s1, CASE WHEN s1 = g_s1 THEN least(p, gp) ELSE 0.0 END AS p FROM a".replace("0.0", "cast(0 as double)")


@dual
def score_substitution(d):
    return with_(d, scored(d), "st2 AS (SELECT rid, s1, cast((rid + s1) % 997 as double) / 997 AS ps FROM scored WHERE p BETWEEN 0.1 AND 0.9)") + "SELECT c.rid, c.s1, round(CASE WHEN c.s1 % 6 = 0 THEN least(c.p, coalesce(x.ps, c.p)) ELSE coalesce(x.ps, c.p) END, 6) AS p FROM scored c LEFT JOIN st2 x ON x.rid = c.rid AND x.s1 = c.s1"


@dual
def recheck_high(d):
    return with_(d, scored(d), "again AS (SELECT rid, s1, cast((rid * 3 + s1) % 101 as double) / 100 AS ps FROM scored WHERE p > 0.9 AND p <= 0.999)") + "SELECT c.rid, c.s1, least(c.p, coalesce(a.ps, c.p)) AS p FROM scored c LEFT JOIN again a ON a.rid = c.rid AND a.s1 = c.s1"


@dual
def sibling_rule(d):
    """A doubtful owner with another house number goes if a sibling of the same source has the right one."""
    return with_(d, scored(d), _siblings(d), "kept AS (SELECT x.* FROM pairs x JOIN best b ON b.rid = x.rid AND b.s1 = x.s1 WHERE x.p >= 0.1)") + "SELECT a.rid, a.s1, a.p FROM kept a WHERE NOT (a.p < 0.95 AND coalesce(a.fne, 1) = 0 AND EXISTS (SELECT 1 FROM kept b WHERE b.s1 = a.s1 AND b.source = a.source AND b.rid <> a.rid AND b.fne = 1))"


@dual
def shift_family(d):
    """House numbers moved up by a known decoy step."""
    return with_(d, scored(d), _siblings(d)) + f"SELECT x.rid, x.s1, x.qn - x.sn AS delta FROM pairs x WHERE x.qn - x.sn IN {SHIFTS} AND NOT EXISTS (SELECT 1 FROM pairs y WHERE y.s1 = x.s1 AND y.rid <> x.rid AND y.qn = x.qn AND y.p >= 0.5)"


@dual
def promoted_family(d):
    return with_(d, scored(d), "p1 AS (SELECT rid, s1, score / 100 AS p1 FROM scored)") + "SELECT c.rid, c.s1 FROM scored c JOIN p1 ON p1.rid = c.rid AND p1.s1 = c.s1 WHERE c.p >= 0.5 AND p1.p1 < 0.3"


@dual
def address_key(d):
    """An address without region words, suffixes split, words in order."""
    text = d.swap(d.swap("address", "(^| )(st|rd|ave)( |$)", " "), "([0-9]+)(bis|ter)", "$1 $2")
    return with_(d, registry(d)) + f"SELECT eid, {d.joined(d.ordered(d.flt(d.words(text), 'x', chr(120) + ' <> ' + chr(39) * 2)))} AS akey FROM q"


@dual
def apply_changes(d):
    """Removals, then additions: one entity for each record, never for a record that still has one."""
    return with_(d, scored(d), "cur AS (SELECT rid, s1 FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p DESC, s1) AS r FROM scored) z WHERE r = 1 AND p >= 0.4)", "rem AS (SELECT rid, s1 FROM cur WHERE rid % 9 = 0)", "adds AS (SELECT rid, s1 FROM truth WHERE rid % 4 = 0)", f"left_ AS (SELECT c.* FROM cur c {'LEFT ANTI' if d.name == 'spark' else 'ANTI'} JOIN rem r ON r.rid = c.rid AND r.s1 = c.s1)", "fresh AS (SELECT a.rid, min(a.s1) AS s1 FROM adds a WHERE NOT EXISTS (SELECT 1 FROM left_ l WHERE l.rid = a.rid) AND EXISTS (SELECT 1 FROM s1 WHERE s1.eid = a.s1) GROUP BY a.rid)") + "SELECT rid, s1 FROM left_ UNION ALL SELECT rid, s1 FROM fresh"


@dual
def empty_entity_fill(d):
    return with_(d, scored(d), _owner(d), "filled AS (SELECT DISTINCT s1 FROM best WHERE p >= 0.5)", "rival AS (SELECT a.rid, a.s1, max(b.p) AS o FROM scored a LEFT JOIN scored b ON b.rid = a.rid AND b.s1 <> a.s1 GROUP BY a.rid, a.s1)") + "SELECT c.rid, c.s1, c.p FROM scored c JOIN rival r ON r.rid = c.rid AND r.s1 = c.s1 WHERE c.p >= 0.3 AND c.p < 0.5 AND coalesce(r.o, 0) < 0.2 AND NOT EXISTS (SELECT 1 FROM filled f WHERE f.s1 = c.s1)"


@dual
def candidate_union(d):
    return with_(d, scored(d)) + "SELECT rid, s1 FROM cand UNION SELECT rid, s1 FROM truth"


@dual
def partial_filter(d):
    """Keep what both runs agree on, drop new pairs that are clearly apart, bring back old pairs that are clearly one."""
    return with_(d, scored(d), "old AS (SELECT rid, s1 FROM scored WHERE p >= 0.5)", "new AS (SELECT rid, s1 FROM scored WHERE p <= 0.6)", "far AS (SELECT c.rid, c.s1 FROM scored c JOIN q ON q.eid = c.rid JOIN s1 s ON s.eid = c.s1 WHERE q.address <> s.address AND q.address <> '')", "near AS (SELECT c.rid, c.s1 FROM scored c JOIN q ON q.eid = c.rid JOIN s1 s ON s.eid = c.s1 WHERE q.name_core = s.name_core)") + "SELECT n.rid, n.s1, 'new' AS origin FROM new n WHERE (n.rid, n.s1) IN (SELECT rid, s1 FROM old) OR NOT EXISTS (SELECT 1 FROM far f WHERE f.rid = n.rid AND f.s1 = n.s1) UNION ALL SELECT o.rid, o.s1, 'restored' FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.rid = o.rid AND n.s1 = o.s1) AND EXISTS (SELECT 1 FROM near x WHERE x.rid = o.rid AND x.s1 = o.s1)"


@dual
def proposal_rules(d):
    """Prioritised proposals for records without an owner: the first rule that holds, the best of them for each record."""
    return with_(d, scored(d), "free AS (SELECT eid FROM q WHERE NOT EXISTS (SELECT 1 FROM scored c WHERE c.rid = q.eid AND c.p >= 0.8))", f"""rule AS (SELECT c.rid, c.s1, CASE WHEN q.address = s.address AND q.name_core = s.name_core THEN 1 WHEN q.address = s.address AND {d.n(d.common('q.name_words', 's.name_words'))} >= 2 THEN 2 WHEN replace(q.name_core, ' ', '') = replace(s.name_core, ' ', '') THEN 3 WHEN q.address = '' AND {d.n(d.less('q.name_words', 's.name_words'))} = 0 THEN 4 ELSE 9 END AS pri FROM cand c JOIN free f ON f.eid = c.rid JOIN qt q ON q.eid = c.rid JOIN st s ON s.eid = c.s1)""") + f"SELECT rid, {d.best('s1', '-pri', '-s1')} AS s1, min(pri) AS pri FROM rule WHERE pri < 9 GROUP BY rid"


@dual
def locale_review(d):
    """Additions at an address that several entities share go; others stay with the number of entities there."""
    return with_(d, scored(d), "at_ AS (SELECT eid, count(*) OVER (PARTITION BY country, address) AS n FROM s1)") + "SELECT c.rid, c.s1, a.n AS at_address FROM scored c JOIN at_ a ON a.eid = c.s1 WHERE c.p >= 0.3 AND a.n = 1"


@dual
def pass_fail_gate(d):
    return with_(d, scored(d), "x AS (SELECT c.s1 % 3 AS grp, CASE WHEN t.s1 = c.s1 THEN 1 ELSE 0 END AS ok FROM scored c LEFT JOIN truth t ON t.rid = c.rid AND t.s1 = c.s1 WHERE c.rk = 1)") + "SELECT grp, count(*) AS n, round(avg(cast(ok as double)), 6) AS share, avg(cast(ok as double)) >= 0.7 AS pass FROM x GROUP BY grp"


@dual
def calibration_audit(d):
    return with_(d, scored(d)) + "SELECT q.country, cast(floor(c.p * 10) as bigint) AS bin, count(*) AS n, round(avg(c.p), 6) AS mean_p, round(avg(cast(CASE WHEN t.s1 = c.s1 THEN 1 ELSE 0 END as double)), 6) AS true_share FROM scored c JOIN q ON q.eid = c.rid LEFT JOIN truth t ON t.rid = c.rid AND t.s1 = c.s1 GROUP BY q.country, cast(floor(c.p * 10) as bigint)"


@dual
def validate_output(d):
    """Violations of the single-owner rule and of membership; both counts are 0."""
    return with_(d, scored(d), _owner(d)) + "SELECT (SELECT count(*) FROM (SELECT rid FROM best GROUP BY rid HAVING count(*) > 1) x) AS several_owners, (SELECT count(*) FROM best b WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.rid = b.rid AND c.s1 = b.s1)) AS outside_candidates"
