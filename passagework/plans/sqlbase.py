"""Common table expressions of the SQL that the queries are held against."""

from __future__ import annotations

FILES = """
docs AS (
  SELECT '/corpus/' || lang || '/' || source || '/doc-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') ||
         CASE WHEN doc_id % 8 <= 2 THEN '.txt' WHEN doc_id % 8 <= 4 THEN '.md' WHEN doc_id % 8 = 5 THEN '.markdown' WHEN doc_id % 8 = 6 THEN '.pdf' ELSE '.docx' END AS path,
         CAST(strlen(text) AS BIGINT) AS size, 1700000000 + (doc_id * 7919) % 31536000 AS modified_secs, sha256(text) AS hash, doc_id, lang, text
  FROM documents),
files AS (SELECT path, size, modified_secs, hash, doc_id, lang FROM docs WHERE doc_id % 8 <> 7),
contents AS (SELECT hash, any_value(text) AS text FROM docs WHERE doc_id % 8 <> 7 GROUP BY hash),
copies AS (SELECT hash, min(path) AS path, count(*) AS copies FROM files GROUP BY hash)"""


def passages(size: int = 200, overlap: int = 30) -> str:
    stride = size - overlap
    return FILES + f""",
cw AS (SELECT hash, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM contents),
passages AS (
  SELECT hash, CAST(i AS BIGINT) AS ordinal, array_to_string(w[i * {stride} + 1:i * {stride} + {size}], ' ') AS text
  FROM (SELECT hash, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= {size} THEN 1 ELSE CAST(ceil((len(w) - {size}) / {stride}.0) AS BIGINT) + 1 END)) AS i FROM cw))"""


def passage_lines(size: int = 200, overlap: int = 30) -> str:
    """plines: first and last line of each passage."""
    stride = size - overlap
    return rf"""
lw AS (
  SELECT hash, line, unnest(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) AS word, unnest(range(1, len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) + 1)) AS nth
  FROM (SELECT hash, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS t FROM (SELECT hash, string_split(text, chr(10)) AS ls FROM contents))),
ln AS (SELECT hash, line, row_number() OVER (PARTITION BY hash ORDER BY line, nth) - 1 AS i FROM lw),
plines AS (
  SELECT p.hash, p.ordinal, min(line) AS start_line, max(line) AS end_line FROM passages p JOIN ln ON ln.hash = p.hash AND i >= p.ordinal * {stride} AND i < p.ordinal * {stride} + {size} GROUP BY p.hash, p.ordinal)"""


INDEX = passages() + r""",
toks AS (
  SELECT hash, ordinal, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}\p{Co}]+')) AS term,
         unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{Co}]+')) AS surface,
         unnest(range(0, len(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{Co}]+')))) AS pos FROM passages),
dl AS (SELECT hash, ordinal, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{Co}]+')) AS BIGINT) AS dl FROM passages),
st AS (SELECT count(*) AS n_units, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(DISTINCT hash || '/' || ordinal) AS doc, count(*) AS cnt FROM toks GROUP BY term)"""

WORDS = """
queries AS (SELECT item_id AS query_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:6], ' ') AS query FROM benchmark)"""

PHRASE = """
qw AS (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark),
queries AS (SELECT item_id AS query_id, '"' || array_to_string(w[2:4], ' ') || '" ' || coalesce(w[6], '') AS query FROM qw)"""


def fixed(rows: list[str]) -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"(CAST({i} AS BIGINT), {quote(q)})" for i, q in enumerate(rows))
    return f"\nqueries AS (SELECT * FROM (VALUES {values}) v(query_id, query))".replace("\t", "' || chr(9) || '")


PARSE = r"""
qp AS (SELECT query_id, string_split(translate(regexp_replace(query, '[\x00-\x1f\x7f-\x9f]', ' ', 'g'), '“”„', repeat(chr(34), 3)), '"') AS parts FROM queries),
qq AS (
  SELECT query_id, parts, list_transform(parts, lambda x, i: i % 2 = 0 AND (len(parts) % 2 = 1 OR i < len(parts)) AND regexp_matches(x, '[\p{L}\p{N}]')) AS inside FROM qp),
qt AS (
  SELECT query_id,
         list_transform(list_filter(parts, lambda x, i: inside[i]), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS phrases,
         list_filter(list_filter(string_split_regex(' ' || array_to_string(list_filter(parts, lambda x, i: NOT inside[i]), ' '), '\s+'), lambda x: x <> ''), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS ws
  FROM qq),
qd AS (SELECT query_id, phrases, list_filter(ws, lambda x, i: list_position(list_transform(ws, lambda y: lower(y)), lower(x)) = i) AS ws FROM qt),
parsed AS (
  SELECT query_id, 'phrase' AS kind, CAST(i AS BIGINT) AS no, phrases[i + 1] AS text FROM (SELECT query_id, phrases, unnest(range(0, len(phrases))) AS i FROM qd)
  UNION ALL
  SELECT query_id, 'word', CAST(n + i AS BIGINT), ws[i + 1] FROM (SELECT query_id, ws, len(phrases) AS n, unnest(range(0, len(ws))) AS i FROM qd))"""

UNCOMMON = r"""
keyed AS (
  SELECT p.*, coalesce(d.doc, 0) AS doc, n_units,
         coalesce(d.doc, 0) <= greatest(n_units * 0.05, 1.0) AS few
  FROM parsed p CROSS JOIN st LEFT JOIN df d ON d.term = regexp_replace(lower(p.text), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')),
placed AS (
  SELECT *, max(CASE WHEN kind = 'word' AND few THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS any_few,
         row_number() OVER (PARTITION BY query_id, kind ORDER BY doc, no) AS place FROM keyed),
terms AS (SELECT query_id, kind, no, text, doc FROM placed WHERE kind = 'phrase' OR few OR (any_few = 0 AND place = 1))"""


def matches(terms: str = "terms", tokens: str = "toks", key: str = "hash, ordinal", name: str = "found") -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in key.split(","))
    own = ", ".join(f"t.{k.strip()}" for k in key.split(","))
    del on
    return rf"""
{name}_t AS (SELECT query_id, kind, no, regexp_extract_all(lower(strip_accents(text)), '[\p{{L}}\p{{N}}\p{{Co}}]+') AS ts FROM {terms}),
{name}_one AS (
  SELECT q.query_id, q.kind, q.no, {own}, count(*) AS tf, list(DISTINCT t.surface) AS surfaces
  FROM {name}_t q JOIN {tokens} t ON len(q.ts) = 1 AND t.term = q.ts[1] GROUP BY q.query_id, q.kind, q.no, {own}),
{name}_at AS (SELECT query_id, kind, no, len(ts) AS n, unnest(ts) AS term, unnest(range(0, len(ts))) AS at FROM {name}_t WHERE len(ts) > 1),
{name}_pl AS (
  SELECT q.query_id, q.kind, q.no, {own}, t.pos - q.at AS start, n, count(DISTINCT q.at) AS c
  FROM {name}_at q JOIN {tokens} t ON t.term = q.term GROUP BY q.query_id, q.kind, q.no, {own}, t.pos - q.at, n),
{name}_many AS (
  SELECT query_id, kind, no, {key}, count(*) AS tf, [chr(1) || no] AS surfaces FROM {name}_pl WHERE c = n GROUP BY query_id, kind, no, {key}),
{name} AS (SELECT * FROM {name}_one UNION ALL SELECT * FROM {name}_many)"""


def bm25(found: str = "found", dl: str = "dl", st: str = "st", key: str = "hash, ordinal", name: str = "scored") -> str:
    return f"""
{name}_h AS (SELECT query_id, no, count(*) AS holding FROM {found} GROUP BY query_id, no),
{name} AS (
  SELECT f.query_id, {key}, round(sum(CASE WHEN ln((n_units - holding + 0.5) / (holding + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_units - holding + 0.5) / (holding + 0.5)) END
           * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score,
         len(list_distinct(flatten(list(surfaces)))) AS matched, count_if(kind = 'phrase') AS phrases
  FROM {found} f JOIN {name}_h USING (query_id, no) JOIN {dl} USING ({key}) CROSS JOIN {st} GROUP BY f.query_id, {key})"""


def hits(limit: int, name: str = "kw") -> str:
    return f"""
{name}_needs AS (SELECT query_id, count_if(kind = 'phrase') AS n_phrases, count_if(kind = 'word') AS n_words FROM terms GROUP BY query_id),
{name}_best AS (
  SELECT s.*, n_phrases, n_words FROM scored s JOIN {name}_needs USING (query_id) WHERE phrases = n_phrases
  QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, hash, ordinal) <= {5 * limit + 20}),
{name} AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash, ordinal) AS rank, hash, ordinal, score, CAST(matched AS BIGINT) AS matched
  FROM {name}_best WHERE n_phrases > 0 OR matched >= ceil(n_words / 2.0)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash, ordinal) <= {limit})"""


def vector(text: str) -> str:
    """A list of 64 doubles."""
    found = rf"list_filter(list_transform(list_filter(string_split_regex({text}, '\s+'), lambda x: x <> ''), lambda x: regexp_replace(lower(x), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda x: x <> '')"
    return f"list_transform({found}, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 64)"


VECTORS = f"""
pv0 AS (SELECT hash, ordinal, {vector('text')} AS b FROM passages),
pv1 AS (SELECT hash, ordinal, list_transform(range(0, 64), lambda x: CAST(CASE WHEN len(b) = 0 THEN (CASE WHEN x = 0 THEN 1 ELSE 0 END) ELSE len(list_filter(b, lambda y: y = x)) END AS DOUBLE)) AS v FROM pv0),
pv AS (SELECT hash, ordinal, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM pv1),
qv0 AS (SELECT query_id, {vector("translate(query, '\"“”', '')")} AS b FROM queries),
qv1 AS (SELECT query_id, list_transform(range(0, 64), lambda x: CAST(CASE WHEN len(b) = 0 THEN (CASE WHEN x = 0 THEN 1 ELSE 0 END) ELSE len(list_filter(b, lambda y: y = x)) END AS DOUBLE)) AS v FROM qv0),
qv AS (SELECT query_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM qv1)"""


def nearest(k: int, name: str = "mean") -> str:
    return f"""
{name} AS (
  SELECT query_id, hash, ordinal, round(list_distance(pv.v, qv.v), 6) AS distance,
         row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(pv.v, qv.v), 6), hash, ordinal) AS rank
  FROM pv CROSS JOIN qv QUALIFY rank <= {k})"""


NAME_INDEX = r"""
ntoks AS (
  SELECT path, unnest(regexp_extract_all(lower(strip_accents(path)), '[\p{L}\p{N}\p{Co}]+')) AS term, unnest(regexp_extract_all(lower(path), '[\p{L}\p{N}\p{Co}]+')) AS surface,
         unnest(range(0, len(regexp_extract_all(lower(path), '[\p{L}\p{N}\p{Co}]+')))) AS pos FROM files),
ndl AS (SELECT path, CAST(len(regexp_extract_all(lower(path), '[\p{L}\p{N}\p{Co}]+')) AS BIGINT) AS dl FROM files),
nst AS (SELECT count(*) AS n_units, avg(dl) AS avgdl FROM ndl),
nq AS (SELECT query_id, list_filter(list_filter(string_split_regex(regexp_replace(query, '[\x00-\x1f\x7f-\x9f]', ' ', 'g'), '\s+'), lambda x: x <> ''), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS ws FROM queries),
nd AS (SELECT query_id, list_filter(ws, lambda x, i: list_position(list_transform(ws, lambda y: lower(y)), lower(x)) = i) AS ws FROM nq),
nterms AS (SELECT query_id, 'word' AS kind, CAST(i AS BIGINT) AS no, ws[i + 1] AS text FROM (SELECT query_id, ws, unnest(range(0, len(ws))) AS i FROM nd))"""


def name_hits(limit: int, name: str = "nm") -> str:
    return matches("nterms", "ntoks", "path", "nfound") + f""",
nholding AS (SELECT query_id, no FROM nfound CROSS JOIN nst GROUP BY query_id, no, n_units HAVING count(*) <= n_units * 0.5),
nkept AS (SELECT f.* FROM nfound f JOIN nholding USING (query_id, no)),
nneeds AS (SELECT query_id, greatest(least(count(*), 2), ceil(count(*) / 2.0)) AS needed FROM nholding GROUP BY query_id),""" + bm25("nkept", "ndl", "nst", "path", "nscored") + f""",
nfirst AS (SELECT hash, min(ordinal) AS ordinal FROM passages GROUP BY hash),
nbest AS (
  SELECT s.*, f.hash, p.ordinal, needed FROM nscored s JOIN nneeds USING (query_id) JOIN files f USING (path) JOIN nfirst p USING (hash)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) <= {5 * limit + 20}),
{name} AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank, path, hash, ordinal, score, CAST(matched AS BIGINT) AS matched
  FROM nbest WHERE matched >= needed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) <= {limit})"""
