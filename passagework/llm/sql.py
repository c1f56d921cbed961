"""DuckDB SQL of this subpackage's queries."""

from __future__ import annotations

QUALITY = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
tri AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, sum(least(3, coalesce(lead_i - i, 3))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead_i FROM twice) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM c),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count_if(base_failed) AS DOUBLE) AS bad FROM f GROUP BY host),
m AS (SELECT sum(bad) / sum(n) AS mean FROM h),
v AS (SELECT max(mean) AS mean, sum(n * (bad / n - mean) * (bad / n - mean)) / sum(n) AS var FROM h, m),
s AS (SELECT mean, CASE WHEN var > 0 THEN greatest(1.0, least(1e6, mean * (1 - mean) / var - 1)) ELSE 1e6 END AS strength FROM v),
r AS (SELECT host, (bad + mean * strength) / (n + strength) > 0.5 AS host_failed FROM h, s)
"""

OP5 = QUALITY + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept, host_failed, nullif(host, '') AS source
FROM f JOIN r USING (host)
"""

OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
v AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM v JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
r AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS key FROM s GROUP BY doc_id),
f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS class_id FROM k)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
       coalesce(f.class_id, w.doc_id) AS class_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id LEFT JOIN f USING (doc_id)
"""

OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
s AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
m AS (SELECT doc_id, i FROM s QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
r AS (
  SELECT doc_id, i, coalesce(max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reach FROM m),
g AS (SELECT doc_id, i, sum(CASE WHEN i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r),
p AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, span),
k AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
t AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last
  FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN t.doc_id IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

OP9 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to, url
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": OP3, "op5_quality_rules": OP5, "op7_suffix_dedup": OP7, "op9_warc": OP9}
