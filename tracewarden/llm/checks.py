"""The same results in DuckDB SQL, where SQL can express them on whole tables."""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"

URL_FILTER = f"""
WITH rules(host, path, action) AS (VALUES
  ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'),
  ('com','/fr/','allow'), ('com','/de/','block')),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {_LOWER}), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         row_number() OVER () AS rid
  FROM pages),
fits AS (
  SELECT p.rid, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.action, length(r.host || r.path)) AS action
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.rid)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.rid = p.rid
"""

WINNOWING = f"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
item AS (
  SELECT coalesce(item_id::varchar, 'null') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
runs AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM runs),
spans AS (
  SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS run
  FROM (SELECT d.rid, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS i FROM doc d, sizes s WHERE len(d.w) >= s.n)),
hits AS (SELECT s.rid, s.i, s.n, r.item_id FROM spans s JOIN runs r ON r.n = s.n AND r.run = s.run),
hit AS (
  SELECT rid, count(DISTINCT word) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS word FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
found AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(h.n_hit, 0)::bigint AS n_hit,
       coalesce(f.n_items, 0)::bigint AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN hit h ON h.rid = d.rid LEFT JOIN found f ON f.rid = d.rid
"""


WARC = """
WITH page AS (
  SELECT page_id, strlen(coalesce(html, ''))::bigint AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
keeper AS (
  SELECT payload_digest, max(page_id) AS keeper FROM page WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN k.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
FROM page p LEFT JOIN keeper k USING (payload_digest)
"""

TOPK = """
WITH usable AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cell AS (SELECT rid, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM usable),
score AS (
  SELECT q.vec_id AS query_id, c.vec_id, c.rid, sum(q.x * c.x)::bigint AS score
  FROM cell q JOIN cell c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM score)
WHERE rank <= 5
"""


def _draw(seed: str, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *(f"coalesce(({p})::varchar, 'null')" for p in parts)])
    return f"('0x' || substr(md5({text}), 1, 15))::bigint"


MIXING = f"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, source, {_draw("mix", "doc_id")} AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM (SELECT source, sum(size)::bigint AS source_size, count(*) AS n FROM doc GROUP BY source)),
weighted AS (
  SELECT *, [3, 1, 2][((rank - 1) % 3)::int + 1] AS weight, 2.0::double * source_size AS cap FROM ranked),
filled AS (
  SELECT *, 1.5::double * sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining
  FROM weighted),
capped AS (SELECT *, cap <= (total - before) / remaining * weight AS is_full FROM filled),
level AS (
  SELECT *, CASE WHEN is_full THEN cap ELSE (total - coalesce(sum(cap) FILTER (is_full) OVER (), 0))
         / sum(weight) FILTER (NOT is_full) OVER () * weight END AS target FROM capped),
src AS (
  SELECT *, ceil(source_size / 64.0::double)::bigint AS blocks,
         CASE WHEN source_size = 0 THEN 0 ELSE least(round(target * ceil(source_size / 64.0::double) / source_size)::bigint,
              2 * ceil(source_size / 64.0::double)::bigint) END AS slots
  FROM level),
placed AS (
  SELECT d.rid, d.doc_id, d.size, s.rank, s.source_size, s.target,
         coalesce(sum(d.size) OVER (PARTITION BY s.rank ORDER BY d.h, d.doc_id, d.size, d.rid
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS first
  FROM doc d JOIN src s ON s.source IS NOT DISTINCT FROM d.source),
pieces AS (
  SELECT rid, rank, block, least(first + size, (block + 1) * 64) - greatest(first, block * 64) AS words
  FROM (SELECT *, unnest(range(first // 64, (first + size - 1) // 64 + 1)) AS block FROM placed WHERE size > 0)),
slot AS (SELECT rank, blocks, unnest(range(0, slots)) AS slot FROM src WHERE slots > 0),
turned AS (SELECT *, slot // blocks AS epoch, {_draw("mix-turn", "rank", "slot // blocks")} AS turn FROM slot),
times AS (
  SELECT rank, ((slot % blocks)::hugeint * ([2305843009213693951, 2305843009213693921][(epoch % 2)::int + 1] % blocks)
         + turn % blocks) % blocks AS block, count(*) AS times
  FROM turned GROUP BY ALL),
taken AS (SELECT p.rid, sum(p.words * t.times)::bigint AS taken FROM pieces p JOIN times t USING (rank, block) GROUP BY p.rid)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0)::bigint AS taken
FROM placed p LEFT JOIN taken t USING (rid)
"""

LINES = f"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
line AS (
  SELECT rid, doc_id, i, own[i] AS line, translate(trim(own[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key
  FROM (SELECT *, unnest(range(1, len(own) + 1)) AS i FROM doc)),
shared AS (
  SELECT key, min(doc_id) AS first FROM line WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT l.*, s.key IS NOT NULL AND l.doc_id IS DISTINCT FROM s.first AS gone FROM line l LEFT JOIN shared s ON l.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*)::bigint AS n_lines, (count(*) FILTER (gone))::bigint AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid
"""

NEGATIVES = """
WITH usable AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cell AS (SELECT rid, vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM usable),
score AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, c.rid, sum(a.x * c.x)::bigint AS score
  FROM cell a JOIN cell c ON a.i = c.i AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
positive AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM score WHERE label = own)
  WHERE place <= 5),
fit AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.place, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY n.score DESC, n.vec_id)::int AS rank
  FROM positive p JOIN score n ON n.anchor_id = p.anchor_id AND n.label <> n.own
       AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM fit WHERE rank <= 10
"""

CHECKS = {
    "op1_mixing": MIXING,
    "op2_warc": WARC,
    "op3_topk": TOPK,
    "op6_url_filter": URL_FILTER,
    "op10_winnowing": WINNOWING,
    "op11_lines": LINES,
    "op13_negatives": NEGATIVES,
}
