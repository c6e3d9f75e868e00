"""DuckDB SQL for what the engine computes with DataFrames: written apart from it, from the definitions."""

from __future__ import annotations

from erloom.operators.blocking import OTHER_CAP, RATIO, SCALE, TOP_K, UNIGRAM_CAP


def keys(alias: str, source: str) -> str:
    pair = lambda a: f"least({a}[i], {a}[i + 1]) || '_' || greatest({a}[i], {a}[i + 1])"
    return f"""{alias} AS (SELECT DISTINCT eid, country, tk, substr(tk, 1, 1) IN ('n', 'a') AS unigram FROM (
  SELECT eid, country, 'n' || unnest(name_words) AS tk FROM {source} UNION ALL SELECT eid, country, 'a' || unnest(address_words) FROM {source}
  UNION ALL SELECT eid, country, 'N' || {pair('name_words')} FROM (SELECT eid, country, name_words, unnest(range(1, len(name_words))) AS i FROM {source})
  UNION ALL SELECT eid, country, 'A' || {pair('address_words')} FROM (SELECT eid, country, address_words, unnest(range(1, len(address_words))) AS i FROM {source})
  UNION ALL SELECT eid, country, 'C' || replace(name_core, ' ', '') FROM {source} WHERE length(name_core) >= 4
  UNION ALL SELECT eid, country, 'X' || n || '|' || a FROM (SELECT eid, country, n, unnest(address_words) AS a FROM (SELECT eid, country, address_words, unnest(name_words) AS n FROM {source}))))"""


def index(alias: str, keys_of: str, registry: str) -> str:
    return f"""{alias} AS (SELECT country, tk, eid, ln(n1 / df::DOUBLE) AS idf FROM (SELECT *, count(*) OVER (PARTITION BY country, tk) AS df, (SELECT count(*) FROM {registry}) AS n1 FROM {keys_of})
  WHERE df <= CASE WHEN unigram THEN {UNIGRAM_CAP} ELSE {OTHER_CAP} END)"""


def candidates(alias: str, query_keys: str, index_of: str, per: str = "rid", other: str = "s1", top: int = TOP_K) -> str:
    return f"""{alias} AS (SELECT rid, s1, (w / {SCALE}.0)::DOUBLE AS score, nkeys, rk FROM (
  SELECT *, max(w) OVER (PARTITION BY {per}) AS best, row_number() OVER (PARTITION BY {per} ORDER BY w DESC, {other}) AS rk FROM (
    SELECT k.eid AS rid, x.eid AS s1, sum(round(idf * {SCALE})::BIGINT)::BIGINT AS w, count(*) AS nkeys FROM {query_keys} k JOIN {index_of} x ON k.country = x.country AND k.tk = x.tk GROUP BY ALL))
  WHERE rk <= {top} AND w >= {RATIO} * best)"""
