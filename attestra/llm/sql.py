"""DuckDB SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL
), item_window AS (
  SELECT DISTINCT item, least(10, len(ws)) AS k, array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS p FROM item WHERE len(ws) > 0)
), doc_window AS (
  SELECT rid, p, k, array_to_string(ws[p : p + k - 1], ' ') AS g
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM doc, (SELECT DISTINCT k FROM item_window) WHERE len(ws) >= k)
), met AS (
  SELECT rid, p, k, item FROM doc_window JOIN item_window USING (k, g)
), hit AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM met) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

OP5 = r"""
WITH cut AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, rh, rp) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), page AS (
  SELECT page_id, host, path, regexp_replace(host, ':\d*$', '') AS name,
    (SELECT max_by(rh || rp, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
    (SELECT max_by(verdict, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS says
  FROM cut
), named AS (
  SELECT *, string_split(name, '.')[-1] AS last1, array_to_string(string_split(name, '.')[-2:], '.') AS last2, array_to_string(string_split(name, '.')[-3:], '.') AS last3,
    CASE says WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad
  FROM page
), placed AS (
  SELECT *, last2 IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in', 'co.nz', 'com.cn', 'co.za') AS two FROM named
), h AS (
  SELECT host, any_value(CASE WHEN two THEN last3 ELSE last2 END) AS domain, any_value(CASE WHEN two THEN last2 ELSE last1 END) AS suffix,
    CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad
  FROM placed GROUP BY host
), d AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL
), s AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL
), level AS (
  SELECT 'h' AS l, n, bad FROM h UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 's', n, bad FROM s
), total AS (
  SELECT l, sum(n) AS n, sum(bad) / sum(n) AS rate, sum(bad * bad / n) AS bb, sum(n * n) AS nn, count(*) - 1 AS g1 FROM level WHERE n > 0 GROUP BY l
), spread AS (
  SELECT l, rate, n - nn / n - g1 AS room,
    CASE WHEN rate > 0 AND rate < 1 AND n - nn / n - g1 > 0 THEN ((bb - n * rate * rate) / (rate * (1 - rate)) - g1) / (n - nn / n - g1) END AS share
  FROM total
), strength AS (
  SELECT l, rate, CASE WHEN share IS NULL THEN 1.0 WHEN share <= 0 THEN 10000.0 ELSE least(greatest(1 / share - 1, 1.0), 10000.0) END AS m FROM spread
), m AS (
  SELECT coalesce(max(rate) FILTER (l = 's'), 0.5) AS rate, coalesce(max(m) FILTER (l = 's'), 1.0) AS ms, coalesce(max(m) FILTER (l = 'd'), 1.0) AS md, coalesce(max(m) FILTER (l = 'h'), 1.0) AS mh FROM strength
), judged AS (
  SELECT host, h.n + mh + 1 AS size,
    (h.bad + mh * ((d.bad + md * ((s.bad + rate * ms) / (s.n + ms))) / (d.n + md))) / (h.n + mh) AS p
  FROM h JOIN d USING (domain, suffix) JOIN s USING (suffix), m
)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN p - 1.645 * sqrt(p * (1 - p) / size) > 0.5 THEN 'block' END, 'allow') AS verdict
FROM page JOIN judged USING (host)
"""

OP7 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), placed AS (
  SELECT *, row_number() OVER o AS k, lag(role) OVER o AS before, length(text) + len(regexp_extract_all(text, '<\\*\|')) AS size FROM turns
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size + CASE WHEN before IS NULL THEN 13 + length(role) WHEN before = role THEN 11 ELSE 24 + length(role) END) + 11 AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {"op2_decontaminate": OP2, "op5_hosts": OP5, "op7_chat": OP7}
