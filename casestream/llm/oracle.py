"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

from . import fill_middle, quality_rules, topk_search, vector_codes

# Mixing, with every quotient laid out: both deals by rank among all of them.
_MIXING = """
WITH s AS (
  SELECT doc_id, source, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
p AS (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS r, CAST(sum(size) AS BIGINT) AS ss, count(*) AS n FROM s GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((r - 1) % 3 + 1 AS INTEGER)] AS w, 3 * ss AS cap FROM p),
f AS (
  SELECT *, CAST(sum(ss) OVER () - coalesce(sum(cap) OVER before, 0) AS BIGINT) AS b, CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS BIGINT) AS ww
  FROM w WINDOW before AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, b * w >= cap * ww AS is_full FROM f),
level AS (SELECT b AS lb, ww AS lw FROM g WHERE NOT is_full ORDER BY ww DESC, b DESC LIMIT 1),
t AS (SELECT source, r, ss, n, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE w * lb / lw END AS target FROM g LEFT JOIN level ON true),
c AS (SELECT *, greatest(1, least(32, CAST(floor(coalesce(min(target) FILTER (target > 0) OVER (), 0) / 64) AS BIGINT))) AS block FROM t),
c2 AS (SELECT *, CAST(round(sum(target) OVER () / block) AS BIGINT) AS seats_all, CAST(ceil(ss * 3 / block) AS BIGINT) AS most FROM c),
qs AS (
  SELECT r, count(*) FILTER (place <= seats_all) AS blocks
  FROM (SELECT r, seats_all, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, r, j) AS place
        FROM (SELECT r, target, seats_all, unnest(range(0, most)) AS j FROM c2 WHERE target > 0)) GROUP BY r),
q AS (SELECT c2.*, coalesce(blocks, 0) AS blocks, CAST(ceil(n / 1024) AS BIGINT) AS shards FROM c2 LEFT JOIN qs USING (r)),
d AS (SELECT s.*, q.r, q.ss, q.target, q.block, q.blocks, CAST('0x' || substr(s.k, 1, 8) AS BIGINT) % q.shards AS shard FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source),
h AS (SELECT r, shard, CAST(sum(size) AS BIGINT) AS n, any_value(block) AS block, any_value(blocks) AS blocks FROM d GROUP BY r, shard),
hs AS (
  SELECT r, shard, count(*) FILTER (place <= blocks) AS seats
  FROM (SELECT r, shard, blocks, row_number() OVER (PARTITION BY r ORDER BY n / (2 * j + 1) DESC, shard, j) AS place
        FROM (SELECT r, shard, n, blocks, unnest(range(0, CAST(ceil(n * 3 / block) AS BIGINT))) AS j FROM h WHERE n > 0)) GROUP BY r, shard),
x AS (
  SELECT h.r, h.shard, h.n, least(coalesce(seats, 0) * h.block, h.n * 3) AS words,
         CAST('0x' || substr(md5('7:' || h.r || ':' || h.shard), 1, 8) AS BIGINT) % greatest(1, CAST(ceil(h.n / h.block) AS BIGINT)) * h.block AS start
  FROM h LEFT JOIN hs ON h.r = hs.r AND h.shard = hs.shard),
e AS (
  SELECT d.*, x.n AS sn, x.words // greatest(x.n, 1) AS rounds, x.start, x.start + x.words % greatest(x.n, 1) AS stop,
         CAST(sum(size) OVER (PARTITION BY d.r, d.shard ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN x ON d.r = x.r AND d.shard = x.shard)
SELECT doc_id, source, size, ss AS source_size, target,
       CAST(rounds * size + greatest(0, least(upto, least(stop, sn)) - greatest(upto - size, start)) + greatest(0, least(upto, stop - sn) - greatest(upto - size, 0)) AS BIGINT) AS taken
FROM e
"""

# Every pair of documents that share a shingle, and the closure of their links.
_NEAR = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') || ' /' ELSE array_to_string(ws[i:i + 4], ' ') END AS x
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

# The formatted length: three marks of eight characters, and the escapes.
_CHAT = """
WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'))) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

ORACLES: dict[str, str] = {
    "op1_mixing": _MIXING,
    "op3_near_dup": _NEAR,
    "op6_quality_rules": quality_rules.ORACLE,
    "rule_ablations": quality_rules.ABLATIONS,
    "op8_topk_search": topk_search.ORACLE,
    "op9_chat_format": _CHAT,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_fill_in_middle": fill_middle.ORACLE,
}
