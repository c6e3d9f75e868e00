"""The training-data queries, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from .ans import op3_ans
from .decontam import op8_decontamination
from .embedding import op6_embeddings
from .html import op5_html
from .langid import op1_langid
from .minhash import op7_minhash
from .packing import op10_packing
from .quality import op2_quality
from .secrets import ACCESS, ASSIGN, HEX, TOKEN, TOKEN_DIGITS, TOKEN_DISTINCT, TOKEN_LETTERS, WIDE_OWNERS, WIDE_REPOSITORIES, op9_secrets
from .sharding import LEAST_BUCKETS, SLOT_ROWS, op4_sharding


QUERIES = {
    "op1_langid": op1_langid,
    "op2_quality": op2_quality,
    "op3_ans": op3_ans,
    "op4_sharding": op4_sharding,
    "op5_html": op5_html,
    "op6_embeddings": op6_embeddings,
    "op7_minhash": op7_minhash,
    "op8_decontamination": op8_decontamination,
    "op9_secrets": op9_secrets,
    "op10_packing": op10_packing,
}

_JUMPED = "(k * 2862933555777941757 + 1) % 18446744073709551616"

_q = lambda pattern: pattern.replace("'", "''")


def _kind(k: int, name: str, pattern: str, group: int, keep: str) -> str:
    return f"""SELECT r, {k} AS k, '{name}' AS kind, v, (e - length(h))::BIGINT AS s, e::BIGINT AS e FROM (
      SELECT r, h, v, sum(length(g) + length(h)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
        SELECT r, unnest(range(1, len(hs) + 1)) AS i, unnest(gs[1:len(hs)]) AS g, unnest(hs) AS h, unnest(vs) AS v FROM (
          SELECT r, string_split_regex(t, '{_q(pattern)}') AS gs, regexp_extract_all(t, '{_q(pattern)}', 0) AS hs, regexp_extract_all(t, '{_q(pattern)}', {group}) AS vs
          FROM d WHERE regexp_matches(t, '{_q(pattern)}')))) WHERE {keep}"""


_TOKEN_LIKE = f"length(regexp_replace(v, '[^0-9]', '', 'g')) >= {TOKEN_DIGITS} AND length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= {TOKEN_LETTERS} AND len(list_distinct(string_split(v, ''))) >= {TOKEN_DISTINCT}"

ORACLES = {
    "op9_secrets": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
base AS (SELECT * FROM ({_kind(0, "assign", ASSIGN, 2, "length(v) >= 6")}) UNION ALL SELECT * FROM ({_kind(1, "access", ACCESS, 1, "true")}) UNION ALL SELECT * FROM ({_kind(2, "hex", HEX, 1, "true")})),
loose AS (SELECT * FROM ({_kind(3, "token", TOKEN, 1, _TOKEN_LIKE)}) x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = x.r AND b.s < x.e AND x.s < b.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM loose),
own AS (SELECT v, count(DISTINCT owner) < {WIDE_OWNERS} AND count(DISTINCT repo) < {WIDE_REPOSITORIES} AS live FROM every JOIN d USING (r) GROUP BY v),
judged AS (SELECT e.*, live FROM every e JOIN own USING (v) WHERE k < 3 OR live)
SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k IS NOT NULL), '') AS spans,
       count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied
FROM d LEFT JOIN judged USING (r) GROUP BY r, doc_id""",
    "op4_sharding": f"""
WITH RECURSIVE tab AS (
  SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS r FROM range(0, 256) s(i))),
d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size, coalesce(text, '') AS t,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
it(h, n, b, k, j) AS (
  SELECT h, n, (-1)::BIGINT, h::HUGEINT, 0::BIGINT FROM (SELECT DISTINCT h FROM d), (VALUES (40), (41)) t(n)
  UNION ALL
  SELECT h, n, j, {_JUMPED}, floor((j + 1) * (2147483648.0::DOUBLE / (({_JUMPED}) // 8589934592 + 1)::DOUBLE))::BIGINT
  FROM it WHERE j < n),
s AS (SELECT h, max(b) FILTER (WHERE n = 40) AS shard, max(b) FILTER (WHERE n = 41) AS grown_shard FROM it WHERE j >= n GROUP BY h),
c AS (SELECT doc_id, size, h, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(d.t)), '..'), lambda x: ('0x' || x)::BIGINT),
         lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM d, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, grown_shard::INTEGER AS grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY (h + size + text_crc32) % greatest({LEAST_BUCKETS}, ((SELECT count(*) FROM d) + {40 * SLOT_ROWS - 1}) // {40 * SLOT_ROWS}), doc_id, size, text_crc32) - 1 AS slot
FROM c JOIN s USING (h)""",
}
