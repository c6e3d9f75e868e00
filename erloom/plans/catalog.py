"""The relational operators that the linkage steps are made of: joins, aggregates, windows, set operations, sources."""

from __future__ import annotations

from erloom.sources.fixtures import registry, texts

from .registry import blocked, dual, scored, with_


def _semi(d, kind: str) -> str:
    return f"LEFT {kind}" if d.name == "spark" else kind


@dual
def join_inner(d):
    return with_(d, registry(d)) + "SELECT q.eid AS rid, s1.eid AS s1, q.name_full, s1.name_full AS s_name FROM q JOIN s1 ON q.country = s1.country AND q.name_full = s1.name_full"


@dual
def join_left(d):
    return with_(d, registry(d)) + "SELECT q.eid AS rid, t.s1, CASE WHEN t.s1 IS NULL THEN 0 ELSE 1 END AS label FROM q LEFT JOIN truth t ON t.rid = q.eid"


@dual
def join_semi(d):
    return with_(d, registry(d)) + f"SELECT q.eid, q.cls FROM q {_semi(d, 'SEMI')} JOIN truth t ON t.rid = q.eid"


@dual
def join_anti(d):
    return with_(d, registry(d)) + f"SELECT q.eid, q.cls FROM q {_semi(d, 'ANTI')} JOIN truth t ON t.rid = q.eid"


@dual
def join_self_typo(d):
    """Typo keys: another word of the same name as an anchor, with the sorted letters of a word short of one letter."""
    w = f"w AS (SELECT eid, name_words, i, {d.at('name_words', 'i')} AS a FROM (SELECT eid, name_words, {d.rows(d.upto(d.n('name_words')))} AS i FROM st) x)"
    return with_(d, registry(d), texts(d, "st", "s1"), w, f"v AS (SELECT eid, i, a, j FROM (SELECT eid, i, a, {d.rows(d.upto('length(a)'))} AS j FROM w) y)") + f"SELECT DISTINCT x.eid, concat(y.a, '|', {d.joined(d.ordered(d.chars('concat(substr(x.a, 1, cast(x.j as int) - 1), substr(x.a, cast(x.j as int) + 1))')), '')}) AS tk FROM v x JOIN w y ON x.eid = y.eid AND x.i <> y.i WHERE length(x.a) >= 4"


@dual
def join_cross_small(d):
    return with_(d, registry(d), f"ks AS {d.values('v', ['(1)', '(5)', '(10)'], 'kk')}") + "SELECT cls, cast(kk as bigint) AS kk, count(*) AS n FROM q CROSS JOIN ks GROUP BY cls, kk"


@dual
def join_competitor(d):
    """The best other candidate of the same record."""
    return with_(d, scored(d)) + "SELECT a.rid, a.s1, max(b.p) AS rival FROM scored a LEFT JOIN scored b ON a.rid = b.rid AND a.s1 <> b.s1 GROUP BY a.rid, a.s1"


@dual
def join_chain(d):
    return with_(d, scored(d), "c1 AS (SELECT rid, s1, p AS p1 FROM scored WHERE p > 0.2)", "c2 AS (SELECT rid, s1, 1 - p AS p2 FROM scored WHERE p < 0.8)") + "SELECT s.rid, s.s1, c1.p1, round(c2.p2, 6) AS p2, t.s1 IS NOT NULL AS label FROM scored s LEFT JOIN c1 ON c1.rid = s.rid AND c1.s1 = s.s1 LEFT JOIN c2 ON c2.rid = s.rid AND c2.s1 = s.s1 LEFT JOIN truth t ON t.rid = s.rid AND t.s1 = s.s1"


@dual
def exists_sibling(d):
    return with_(d, scored(d)) + f"SELECT a.rid, a.s1 FROM scored a WHERE EXISTS (SELECT 1 FROM scored b WHERE b.s1 = a.s1 AND b.rid <> a.rid AND b.p > a.p)"


@dual
def not_exists_blocked(d):
    return with_(d, scored(d)) + "SELECT t.rid, t.s1 FROM truth t WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.rid = t.rid AND c.s1 = t.s1)"


@dual
def tuple_in(d):
    return with_(d, scored(d)) + "SELECT rid, s1, p FROM scored WHERE (rid, s1) IN (SELECT rid, s1 FROM truth)"


@dual
def not_in_assigned(d):
    return with_(d, scored(d)) + "SELECT eid AS rid, cls FROM q WHERE NOT EXISTS (SELECT 1 FROM scored c WHERE c.rid = q.eid AND c.p >= 0.5)"


@dual
def scalar_subqueries(d):
    return with_(d, scored(d)) + "SELECT (SELECT count(*) FROM q) AS records, (SELECT count(*) FROM s1) AS entities, (SELECT count(*) FROM truth) AS pairs, (SELECT count(*) FROM scored) AS candidates"


@dual
def filter_agg(d):
    return f"SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 1000) AS large, max(o_totalprice) FILTER (WHERE o_orderpriority LIKE '1%') AS top_urgent FROM {d.t('orders')} GROUP BY o_orderstatus"


@dual
def count_distinct(d):
    return f"SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM {d.t('lineitem')} GROUP BY l_returnflag"


@dual
def count_distinct_tuple(d):
    return f"SELECT count(*) AS pairs FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {d.t('lineitem')}) x"


@dual
def argmax_tuple(d):
    return with_(d, scored(d)) + f"SELECT rid, {d.best('s1', 'p', '-s1')} AS s1, max(p) AS p FROM scored GROUP BY rid"


@dual
def argmin_tuple(d):
    return with_(d, scored(d)) + f"SELECT s1, {d.best('rid', '-p', '-rid')} AS rid FROM scored GROUP BY s1"


@dual
def top2_agg(d):
    """The two largest scores of each entity by rank, not by collecting them."""
    return with_(d, scored(d)) + "SELECT s1, max(CASE WHEN r = 1 THEN p END) AS p1, max(CASE WHEN r = 2 THEN p END) AS p2 FROM (SELECT s1, p, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, rid) AS r FROM scored) x WHERE r <= 2 GROUP BY s1"


@dual
def bool_aggs(d):
    return with_(d, scored(d)) + "SELECT rid, bool_or(p > 0.5) AS any_half, bool_and(p > 0.5) AS all_half, any_value(rid % 10) AS digit FROM scored GROUP BY rid"


@dual
def string_agg_ordered(d):
    return with_(d, scored(d)) + f"SELECT s1, {d.listed('cast(rid as varchar(12))', 'rid')} AS ids FROM scored WHERE p >= 0.4 GROUP BY s1"


@dual
def first_ordered(d):
    return with_(d, scored(d)) + f"SELECT rid, {d.best('s1', 'score', '-s1')} AS first_s1, cast(count(CASE WHEN p > 0.5 THEN 1 END) as bigint) AS n_half FROM scored GROUP BY rid"


@dual
def rollup_country(d):
    return with_(d, registry(d)) + "SELECT coalesce(country, 'all') AS country, grouping(country) = 1 AS is_total, count(*) AS n FROM q GROUP BY ROLLUP (country)"


@dual
def group_by_all(d):
    return with_(d, registry(d)) + "SELECT country, cls, count(*) AS n FROM q GROUP BY ALL"


@dual
def having_caps(d):
    return f"SELECT l_partkey, count(*) AS n FROM {d.t('lineitem')} GROUP BY l_partkey HAVING count(*) BETWEEN 20 AND 30"


@dual
def quantiles(d):
    if d.name == "spark":
        cut = lambda q: f"percentile(l_extendedprice, {q})"
    else:
        cut = lambda q: f"quantile_cont(l_extendedprice, {q})"
    return f"SELECT l_returnflag, round(median(l_quantity), 6) AS med, round({cut(0.25)}, 6) AS q25, round({cut(0.9)}, 6) AS q90 FROM {d.t('lineitem')} GROUP BY l_returnflag"


@dual
def crosstab(d):
    cols = ", ".join(f"count(CASE WHEN cls = {c} THEN 1 END) AS cls_{c}" for c in range(12))
    return with_(d, registry(d)) + f"SELECT country, {cols} FROM q GROUP BY country"


@dual
def list_agg_set(d):
    return with_(d, registry(d)) + f"SELECT country, {d.joined(d.gathered_set('brand'))} AS brands FROM base GROUP BY country"


@dual
def vocab_df(d):
    return with_(d, registry(d), texts(d, "st", "s1"), f"w AS (SELECT DISTINCT eid, country, w FROM (SELECT eid, country, {d.rows('name_words')} AS w FROM st) x)") + "SELECT country, w, count(*) AS df FROM w GROUP BY country, w"


@dual
def rownum_topk(d):
    return f"SELECT o_custkey, o_orderkey, cast(r as bigint) AS r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {d.t('orders')}) x WHERE r <= 3"


@dual
def max_over_ratio(d):
    return f"SELECT o_custkey, o_orderkey FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM {d.t('orders')}) x WHERE o_totalprice >= 0.5 * top"


@dual
def count_over(d):
    return with_(d, registry(d)) + "SELECT eid, count(*) OVER (PARTITION BY country, address) AS at_address FROM s1"


@dual
def distinct_over(d):
    # a distinct count over a window is the highest dense rank in it
    return with_(d, registry(d)) + "SELECT k, count(*) OVER w AS n, cast(max(r) OVER w as bigint) AS brands FROM (SELECT *, dense_rank() OVER (PARTITION BY country, sz ORDER BY brand) AS r FROM base) x WINDOW w AS (PARTITION BY country, sz)" if d.name == "spark" else with_(d, registry(d)) + "SELECT k, count(*) OVER w AS n, count(DISTINCT brand) OVER w AS brands FROM base WINDOW w AS (PARTITION BY country, sz)"


@dual
def rank_min(d):
    return with_(d, scored(d)) + "SELECT rid, s1, cast(rank() OVER (PARTITION BY rid ORDER BY p DESC) as bigint) AS r FROM scored"


@dual
def is_first(d):
    return with_(d, scored(d)) + "SELECT rid, s1, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, rid) = 1 AS is_best FROM scored"


@dual
def lead_next(d):
    return with_(d, scored(d)) + "SELECT rid, s1, p, lead(p) OVER (PARTITION BY s1 ORDER BY p DESC, rid) AS next_p FROM scored"


@dual
def union_all(d):
    return f"SELECT c_nationkey AS nk, 'c' AS kind FROM {d.t('customer')} UNION ALL SELECT s_nationkey, 's' FROM {d.t('supplier')}"


@dual
def union_distinct(d):
    return f"SELECT c_nationkey AS nk FROM {d.t('customer')} UNION SELECT s_nationkey FROM {d.t('supplier')}"


@dual
def except_pairs(d):
    return with_(d, scored(d)) + "SELECT rid, s1 FROM scored WHERE p >= 0.3 EXCEPT SELECT rid, s1 FROM truth"


@dual
def swap_sets(d):
    """What two assignments differ in, both ways."""
    return with_(d, scored(d), "old AS (SELECT rid, s1 FROM scored WHERE p >= 0.5)", "new AS (SELECT rid, s1 FROM scored WHERE p >= 0.4 AND rk = 1)") + "SELECT 'added' AS what, rid, s1 FROM (SELECT * FROM new EXCEPT SELECT * FROM old) a UNION ALL SELECT 'removed', rid, s1 FROM (SELECT * FROM old EXCEPT SELECT * FROM new) b"


@dual
def null_safe_compare(d):
    return with_(d, registry(d)) + "SELECT q.eid, q.address IS DISTINCT FROM s1.address AS differs FROM q JOIN s1 ON q.k = s1.k"


@dual
def like_predicates(d):
    return with_(d, registry(d)) + f"SELECT eid FROM q WHERE name_full LIKE '%llc' AND name_core ILIKE '%B%' AND NOT {"startswith" if d.name == "spark" else "starts_with"}(name_core, 'r') AND contains(address, ' st ')"


@dual
def band_filter(d):
    return with_(d, scored(d)) + "SELECT rid, s1, p FROM scored WHERE p BETWEEN 0.1 AND 0.9 AND rk <= 2"


@dual
def star_exclude(d):
    star = "* EXCEPT (p_retailprice, p_size)" if d.name == "spark" else "* EXCLUDE (p_retailprice, p_size)"
    return f"SELECT {star} FROM {d.t('part')}"


@dual
def limit_offset(d):
    return f"SELECT o_orderkey, o_totalprice FROM {d.t('orders')} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10"


@dual
def hash_sample(d):
    """A repeatable sample: the first 100 rows in the order of a hash of the key."""
    h = d.md5n("cast(o_orderkey as varchar(12))")
    return f"SELECT o_orderkey, {h} AS h FROM {d.t('orders')} ORDER BY {h}, o_orderkey LIMIT 100"


@dual
def split_by_record(d):
    """Group-safe split: a record is held out if any of its candidate entities is in the slice."""
    return with_(d, scored(d)) + "SELECT rid, CASE WHEN bool_or(s1 % 20 = 0) THEN 'valid' WHEN max(rid) % 2 = 0 THEN 'train' ELSE 'unused' END AS part FROM scored GROUP BY rid"


@dual
def type_assert(d):
    n = "'bigint'" if d.name == "spark" else "lower(typeof(eid))"
    got = "typeof(eid)" if d.name == "spark" else n
    return with_(d, registry(d)) + f"SELECT {got} AS kind, count(*) AS n FROM q GROUP BY {got}"


@dual
def schema_peek(d):
    return f"SELECT count(*) AS n, count(p_name) AS names, min(p_partkey) AS lo, max(p_partkey) AS hi FROM {d.t('part')}"


@dual
def write_matching(d):
    """The result file: one row for every entity, its records in order."""
    return with_(d, scored(d), "pred AS (SELECT rid, s1 FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p DESC, s1) AS r FROM scored) z WHERE r = 1 AND p >= 0.5)", f"ids AS (SELECT s1, {d.listed('id', 'id')} AS ids FROM (SELECT s1, concat('S', cast({d.div('rid', 10000000000)} as varchar(2)), '-', cast(rid % 10000000000 as varchar(12))) AS id FROM pred) x GROUP BY s1)") + "SELECT concat('S1-', cast(s1.k as varchar(12))) AS source1_entity_id, coalesce(ids.ids, '') AS matched_entity_ids FROM s1 LEFT JOIN ids ON ids.s1 = s1.eid"


@dual
def pair_text(d):
    return with_(d, scored(d)) + "SELECT c.rid, c.s1, concat(q.name_full, ' | ', coalesce(q.address, '')) AS q_text, concat(s.name_full, ' | ', coalesce(s.address, '')) AS s_text FROM cand c JOIN q ON q.eid = c.rid JOIN s1 s ON s.eid = c.s1"


@dual
def logit_clip(d):
    return with_(d, scored(d)) + "SELECT rid, s1, round(ln(least(greatest(p, 0.000001), 0.999999) / (1 - least(greatest(p, 0.000001), 0.999999))), 6) AS z FROM scored"
