"""The engine's queries by name, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..functions import vectors as V
from ..operators import chunk, fuse, keyword, names, nearest, postings, results
from ..schema import DEFAULT_PATTERNS, Filter
from ..sources.corpus import KEY, LITERAL_QUERIES, NAME_QUERIES, NOW, ROOT, Corpus
from . import search as S
from . import sqlbase as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Callable[[Corpus], DataFrame]], Callable[[Corpus], DataFrame]]:
    """Adds a function of a corpus as a query."""

    def add(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Corpus(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return add


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# 1. files, kinds, patterns and filters


@register("scan_listing", with_(B.FILES, "SELECT path, size, modified_secs FROM docs ORDER BY path"))
def _(c: Corpus) -> DataFrame:
    return c.listing.select("path", "size", "modified_secs").orderBy("path")


_HIDDEN = "concat_ws('/', '/corpus', CASE WHEN doc_id % 5 = 0 THEN '.cache' ELSE lang END, CASE WHEN doc_id % 9 = 0 THEN '.' ELSE '' END || doc_id || '.txt')"


@register("hidden_files", f"SELECT {_HIDDEN} AS path, doc_id % 5 = 0 OR doc_id % 9 = 0 AS hidden FROM documents")
def _(c: Corpus) -> DataFrame:
    path = F.expr(_HIDDEN.replace("doc_id ||", "cast(doc_id as string) ||"))
    return c.table("documents").select(path.alias("path")).withColumn("hidden", P.hidden(F.col("path"), ROOT))


@register("document_kinds", with_(B.FILES, "SELECT path, CASE WHEN doc_id % 8 <= 5 THEN 'text' WHEN doc_id % 8 = 6 THEN 'pdf' END AS kind FROM docs"))
def _(c: Corpus) -> DataFrame:
    return c.listing.select("path", P.kind(F.col("path")).alias("kind"))


@register("content_hash", "SELECT doc_id, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def _(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", "hash", "size")


@register("dedup_contents", with_(B.FILES, "SELECT hash, CAST(strlen(text) AS BIGINT) AS size FROM contents"))
def _(c: Corpus) -> DataFrame:
    return c.contents.select("hash", F.octet_length("text").cast("long").alias("size"))


@register("copies_per_content", with_(B.FILES, "SELECT hash, path, copies, CASE WHEN copies > 1 THEN '(+' || (copies - 1) || ' identical)' ELSE '' END AS note FROM copies"))
def _(c: Corpus) -> DataFrame:
    return results.copies(c.files).withColumn("note", results.copies_note(F.col("copies")))


_GLOBS = ["doc-0000*", "*7.MD", "src1?", "d?c-000111.txt"]


@register("exclude_globs", with_(B.FILES, r"SELECT path FROM docs WHERE NOT (regexp_matches(lower(path), '/doc-0000[^/]*$') OR regexp_matches(lower(path), '7\.md$') OR regexp_matches(path, '/src1.(/|$)') OR regexp_matches(lower(path), '/d.c-000111\.txt$'))"))
def _(c: Corpus) -> DataFrame:
    return c.listing.where(~P.excluded(F.col("path"), ROOT, _GLOBS, [])).select("path")


@register("exclude_folders", with_(B.FILES, "SELECT path FROM docs WHERE NOT (starts_with(path, '/corpus/de/') OR starts_with(path, '/corpus/en/src1/'))"))
def _(c: Corpus) -> DataFrame:
    return c.listing.where(~P.excluded(F.col("path"), ROOT, DEFAULT_PATTERNS, ["/corpus/de", "/corpus/en/src1/"])).select("path")


_PATTERN_CASES = ["*.key", " ", "", "a/b", "a\\b", "x" * 200, "x" * 201, "tab\there", "ok?", "é*"]


@register(
    "pattern_validation",
    "SELECT * FROM (VALUES " + ", ".join(f"({i}, {w})" for i, w in enumerate(["NULL", "'empty'", "'empty'", "'separator'", "'separator'", "NULL", "'too long'", "'control character'", "NULL", "NULL"])) + ") v(no, fault)",
)
def _(c: Corpus) -> DataFrame:
    rows = c.spark.createDataFrame(list(enumerate(_PATTERN_CASES)), "no int, pattern string")
    return rows.select("no", P.pattern_fault(F.col("pattern")).alias("fault"))


def _filtered(name: str, f: Filter, where: str) -> None:
    @register(name, with_(B.FILES, f"SELECT path FROM docs WHERE {where}"))
    def _(c: Corpus) -> DataFrame:
        return c.listing.where(P.admits(F.col("path"), F.col("modified_secs"), f)).select("path")


_filtered("filter_folder", Filter(folders=("/corpus/fr/", "/corpus/en/src2")), "starts_with(path, '/corpus/fr/') OR starts_with(path, '/corpus/en/src2/')")
_filtered("filter_kind", Filter(extensions=("txt", "md", "markdown")), "doc_id % 8 <= 5")
_filtered("filter_date", Filter(modified_since=NOW - 366 * 86400), f"modified_secs >= {NOW - 366 * 86400}")


@register("strip_controls", r"SELECT doc_id, regexp_replace(chr(1) || text || chr(9) || chr(127) || 'x' || chr(133), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g') AS text FROM documents")
def _(c: Corpus) -> DataFrame:
    raw = F.concat(F.lit("\u0001"), F.col("text"), F.lit("\t\u007fx\u0085"))
    return c.table("documents").select("doc_id", X.strip_controls(raw).alias("text"))


# 2. passages


@register("chunk_words_200_30", with_(B.passages(), "SELECT hash, ordinal, text FROM passages"))
def _(c: Corpus) -> DataFrame:
    return c.passages.select("hash", "ordinal", "text")


@register("chunk_words_50_5", with_(B.passages(50, 5), "SELECT hash, ordinal, md5(text) AS digest FROM passages"))
def _(c: Corpus) -> DataFrame:
    return Corpus(c.spark, c.folder, 50, 5).passages.select("hash", "ordinal", F.md5("text").alias("digest"))


@register(
    "chunk_lines",
    with_(
        B.FILES,
        r""", ln AS (SELECT hash, string_split(text, chr(10)) AS ls FROM contents),
le AS (SELECT hash, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS t FROM ln),
lw AS (SELECT hash, line, unnest(range(0, len(w))) AS j FROM (SELECT hash, line, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS w FROM le)),
nw AS (SELECT hash, line, row_number() OVER (PARTITION BY hash ORDER BY line, j) - 1 AS k, count(*) OVER (PARTITION BY hash) AS n FROM lw),
pw AS (SELECT hash, line, unnest(range(greatest(0, CAST(ceil((k - 19) / 15.0) AS BIGINT)), k // 15 + 1)) AS ordinal, n FROM nw)
SELECT hash, ordinal, min(line) AS start_line, max(line) AS end_line FROM pw WHERE ordinal = 0 OR ordinal <= ceil((n - 20) / 15.0) GROUP BY hash, ordinal""".lstrip(", "),
    ).replace("copies AS (SELECT hash, min(path) AS path, count(*) AS copies FROM files GROUP BY hash)\nln", "copies AS (SELECT hash, min(path) AS path, count(*) AS copies FROM files GROUP BY hash),\nln"),
)
def _(c: Corpus) -> DataFrame:
    return chunk.chunk_words(c.contents, 20, 5).select("hash", "ordinal", "start_line", "end_line")


@register(
    "chunk_pages",
    r"""WITH w AS (SELECT sha256(CAST(conv_id AS VARCHAR)) AS hash, turn + 1 AS page, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT hash, page, i, array_to_string(w[i * 15 + 1:i * 15 + 20], ' ') AS text
  FROM (SELECT hash, page, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 20 THEN 1 ELSE CAST(ceil((len(w) - 20) / 15.0) AS BIGINT) + 1 END)) AS i FROM w))
SELECT hash, row_number() OVER (PARTITION BY hash ORDER BY page, i) - 1 AS ordinal, page, text FROM p""",
)
def _(c: Corpus) -> DataFrame:
    pages = c.table("conversations").select(F.sha2(F.col("conv_id").cast("string"), 256).alias("hash"), (F.col("turn") + 1).alias("page"), "text")
    return chunk.chunk_pages(pages, 20, 5).select("hash", "ordinal", "page", "text")


@register("opening_words", r"SELECT doc_id, array_to_string(w[1:30], ' ') || CASE WHEN len(w) > 30 THEN ' ...' ELSE '' END AS opening FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)")
def _(c: Corpus) -> DataFrame:
    return c.table("documents").select("doc_id", X.opening(F.col("text")).alias("opening"))


@register("one_line", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM documents")
def _(c: Corpus) -> DataFrame:
    return c.table("documents").select("doc_id", X.one_line(F.col("text")).alias("line"))


# 3. the inverted index


@register("postings", with_(B.INDEX, "SELECT hash, ordinal, term, surface, count(*) AS tf, min(pos) AS first_pos FROM toks GROUP BY ALL"))
def _(c: Corpus) -> DataFrame:
    return c.index.select(*KEY, "term", "surface", "tf", F.element_at("positions", 1).alias("first_pos"))


@register("doc_lengths", with_(B.INDEX, "SELECT hash, ordinal, dl FROM dl"))
def _(c: Corpus) -> DataFrame:
    return c.lengths


@register("term_df", with_(B.INDEX, "SELECT term, doc, cnt FROM df"))
def _(c: Corpus) -> DataFrame:
    return c.df


@register("vocab_top", with_(B.INDEX, "SELECT term, doc, cnt FROM df ORDER BY cnt DESC, term LIMIT 50"))
def _(c: Corpus) -> DataFrame:
    return c.df.orderBy(F.desc("cnt"), "term").limit(50)


@register("corpus_stats", with_(B.INDEX, "SELECT n_units, round(avgdl, 6) AS avgdl FROM st"))
def _(c: Corpus) -> DataFrame:
    return c.stats.select("n_units", F.round("avgdl", 6).alias("avgdl"))


# 4. search by words

_LITERAL = B.fixed(LITERAL_QUERIES)


@register("parse_query", with_(_LITERAL + "," + B.PARSE, "SELECT query_id, kind, no, text FROM parsed"))
def _(c: Corpus) -> DataFrame:
    return keyword.parse(c.fixed_queries(LITERAL_QUERIES))


@register("query_words", with_(B.WORDS + "," + B.PARSE, "SELECT query_id, no, text FROM parsed"))
def _(c: Corpus) -> DataFrame:
    return keyword.parse(c.queries_words).select("query_id", "no", "text")


def _keyword_sql(queries: str, limit: int) -> str:
    return B.INDEX + "," + queries + "," + B.PARSE + "," + B.UNCOMMON + "," + B.matches() + "," + B.bm25() + "," + B.hits(limit)


def _search(c: Corpus, queries: DataFrame, limit: int) -> DataFrame:
    return S.keyword_search(c, queries, limit)


@register("uncommon_words", with_(B.INDEX + "," + _LITERAL + "," + B.PARSE + "," + B.UNCOMMON, "SELECT query_id, kind, no, text, doc FROM terms"))
def _(c: Corpus) -> DataFrame:
    return keyword.uncommon(keyword.parse(c.fixed_queries(LITERAL_QUERIES)), c.df, c.stats)


@register("bm25_topk", with_(_keyword_sql(B.WORDS, 10), "SELECT query_id, hash, ordinal, score, CAST(matched AS BIGINT) AS matched FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash, ordinal) <= 50"))
def _(c: Corpus) -> DataFrame:
    c = c.narrowed(c.queries_words)
    return c.found.best(50, whole=False).select("query_id", *KEY, "score", "matched")


@register("keyword_half_rule", with_(_keyword_sql(B.WORDS, 10), "SELECT * FROM kw"))
def _(c: Corpus) -> DataFrame:
    return _search(c.narrowed(c.queries_words), c.queries_words, 10)


@register("keyword_phrase", with_(_keyword_sql(B.PHRASE, 10), "SELECT * FROM kw"))
def _(c: Corpus) -> DataFrame:
    return _search(c.narrowed(c.queries_phrase), c.queries_phrase, 10)


@register("keyword_search", with_(_keyword_sql(_LITERAL, 10) + ", shown AS (SELECT kw.*, path, copies FROM kw JOIN copies USING (hash))", "SELECT query_id, rank, path, copies, hash, ordinal, score, matched FROM shown"))
def _(c: Corpus) -> DataFrame:
    queries = c.fixed_queries(LITERAL_QUERIES)
    c = c.narrowed(queries)
    hits = F.broadcast(c.scratch.save(_search(c, queries, 10), "hits", small=True))
    return results.copies(c.files.join(hits.select("hash").distinct(), "hash", "left_semi")).join(hits, "hash").select("query_id", "rank", "path", "copies", *KEY, "score", "matched")


_TERMS = ["the", "und", "de", "that", "ete"]
_MARK = r"""list_transform(regexp_extract_all({t}, '[\p{{L}}\p{{N}}\p{{Co}}]+|[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda p: CASE WHEN list_contains(['the', 'und', 'de', 'that', 'ete'], lower(strip_accents(p))) THEN chr(2) || p || chr(3) ELSE p END)"""


@register("highlight", with_(B.passages(), f"SELECT hash, ordinal, array_to_string({_MARK.format(t='text')}, '') AS marked FROM passages"))
def _(c: Corpus) -> DataFrame:
    return c.passages.select(*KEY, keyword.highlight(F.col("text"), F.array(*map(F.lit, _TERMS))).alias("marked"))


@register(
    "snippet",
    with_(
        B.passages()
        + r""",
sw AS (SELECT hash, ordinal, string_split(text, ' ') AS w FROM passages),
sh AS (SELECT hash, ordinal, w, list_transform(w, lambda x: CASE WHEN len(list_intersect(regexp_extract_all(lower(strip_accents(x)), '[\p{L}\p{N}\p{Co}]+'), ['the', 'und', 'de', 'that', 'ete'])) > 0 THEN 1 ELSE 0 END) AS h FROM sw),
ss AS (SELECT hash, ordinal, w, h, unnest(range(0, greatest(len(w) - 24, 0) + 1)) AS s FROM sh),
sb AS (SELECT hash, ordinal, w, s FROM ss QUALIFY row_number() OVER (PARTITION BY hash, ordinal ORDER BY list_sum(h[s + 1:s + 24]) DESC, s) = 1),
sx AS (SELECT hash, ordinal, len(w) AS n, s, array_to_string(w[s + 1:s + 24], ' ') AS t FROM sb)""",
        f"SELECT hash, ordinal, CASE WHEN s > 0 THEN '... ' ELSE '' END || array_to_string({_MARK.format(t='t')}, '') || CASE WHEN s + 24 < n THEN ' ...' ELSE '' END AS snippet FROM sx",
    ),
)
def _(c: Corpus) -> DataFrame:
    return keyword.with_snippet(c.passages.select(*KEY, "text"), F.array(*map(F.lit, _TERMS))).drop("text")


# 5. vectors

_KNN = "SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6), e.vec_id) AS rank, e.vec_id, round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS distance FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY rank <= 10"


def _knn(c: Corpus) -> DataFrame:
    e = c.table("embeddings")
    return nearest.knn(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), ["vec_id"], 10)


@register("knn_l2", _KNN)
def _(c: Corpus) -> DataFrame:
    return _knn(c).drop("score")


@register("knn_cosine_score", f"SELECT query_id, rank, vec_id, round(1 - distance * distance / 2, 6) AS score FROM ({_KNN})")
def _(c: Corpus) -> DataFrame:
    return _knn(c).drop("distance")


@register("unit_length", "SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(list_dot_product(v, v), 6) AS squared FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS v FROM embeddings)")
def _(c: Corpus) -> DataFrame:
    tripled = F.transform(V.doubles(F.col("embedding")), lambda x: x * 3)
    return c.table("embeddings").select("vec_id", F.round(F.element_at(V.unit(tripled), 1), 6).alias("first"), F.round(V.dot(tripled, tripled), 6).alias("squared"))


@register("mean_pool", "SELECT label, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS x1, round(avg(CAST(embedding[64] AS DOUBLE)), 6) AS x64 FROM embeddings GROUP BY label")
def _(c: Corpus) -> DataFrame:
    pooled = V.mean_of_groups(c.table("embeddings"), "label", "embedding", 64)
    return pooled.select("label", "n", F.round(F.element_at("embedding", 1), 6).alias("x1"), F.round(F.element_at("embedding", 64), 6).alias("x64"))


@register("dot_product", "SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dot FROM embeddings a JOIN (SELECT * FROM embeddings WHERE vec_id = 0) b ON true")
def _(c: Corpus) -> DataFrame:
    e = c.table("embeddings")
    one = e.where("vec_id = 0").select(V.doubles(F.col("embedding")).alias("one"))
    return e.join(F.broadcast(one)).select("vec_id", F.round(V.dot(V.doubles(F.col("embedding")), F.col("one")), 6).alias("dot"))


@register("word_model_md5", with_(B.passages() + "," + B.WORDS + "," + B.VECTORS, "SELECT hash, ordinal, CAST(i AS BIGINT) AS axis, round(v[i + 1], 6) AS x FROM (SELECT hash, ordinal, v, unnest(range(0, 64)) AS i FROM pv) WHERE v[i + 1] <> 0"))
def _(c: Corpus) -> DataFrame:
    return S.passage_vectors(c).select(*KEY, F.posexplode_outer("embedding").alias("axis", "x")).where("x <> 0").select(*KEY, F.col("axis").cast("long").alias("axis"), F.round("x", 6).alias("x"))


@register("passages_without_vectors", with_(B.passages(), "SELECT hash, ordinal FROM passages WHERE ordinal % 3 = 1"))
def _(c: Corpus) -> DataFrame:
    have = S.passage_vectors(c).where("ordinal % 3 <> 1")
    return nearest.missing(c.passages, have, KEY).select(*KEY)


@register("put_vectors", "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 1.0 ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS x1 FROM embeddings WHERE vec_id % 4 <> 0 OR vec_id % 8 <> 0 OR vec_id % 4 = 0")
def _(c: Corpus) -> DataFrame:
    old = c.table("embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("embedding"))
    axis = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    new = old.where("vec_id % 4 = 0").select("vec_id", axis.alias("embedding")).union(c.spark.createDataFrame([(-1, [0.0] * 64)], "vec_id long, embedding array<double>"))
    return nearest.put(old, new, old, ["vec_id"], 64).select("vec_id", F.round(F.element_at("embedding", 1), 6).alias("x1"))


@register("meaning_notes", "SELECT * FROM (VALUES (0, 'meaning-off'), (1, 'not-embedded-yet'), (2, 'other-model old@1'), (3, 'partial 3 of 9'), (4, NULL)) v(no, note)")
def _(c: Corpus) -> DataFrame:
    cases = [(None, "m@1", 9, 9), ("m@1", None, 9, 0), ("m@1", "old@1", 9, 9), ("m@1", "m@1", 9, 3), ("m@1", "m@1", 9, 9)]
    return c.spark.createDataFrame([(i, S.notes(*x)) for i, x in enumerate(cases)], "no int, note string")


# 6. names and fusion

_NAMES = B.fixed(NAME_QUERIES)


@register("name_search", with_(B.passages() + "," + _NAMES + "," + B.NAME_INDEX + "," + B.name_hits(20), "SELECT query_id, rank, path, hash, ordinal, score, matched FROM nm"))
def _(c: Corpus) -> DataFrame:
    return names.search(c.fixed_queries(NAME_QUERIES), c.files, names.first_passages(c.passages), 20)


def _fused(lists: dict[str, str], name: str = "fused") -> str:
    parts = " UNION ALL ".join(f"SELECT query_id, hash, ordinal, {i} AS list, rank FROM {lists[n]}" for i, n in enumerate(fuse.LISTS) if n in lists)
    return f"""
{name}_g AS (
  SELECT query_id, hash, ordinal, round(sum(1.0 / (60.0 + rank)), 6) AS score, min(list * 1000000 + rank) AS first,
         CASE WHEN bool_or(list = 0) AND bool_or(list = 1) THEN 'both' WHEN bool_or(list = 0) THEN 'keyword' WHEN bool_or(list = 1) THEN 'meaning' ELSE 'name' END AS found
  FROM ({parts}) GROUP BY query_id, hash, ordinal),
{name} AS (SELECT query_id, hash, ordinal, score, found, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM {name}_g)"""


def _within(table: str, where: str, name: str) -> str:
    """``fuse.within`` for hits (query_id, rank, path, hash, ordinal)."""
    return f"""
{name}_ok AS (SELECT hash, path FROM files WHERE {where}),
{name}_c AS (SELECT hash, min(path) AS first FROM {name}_ok GROUP BY hash),
{name} AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, hash, ordinal,
         CASE WHEN h.path IN (SELECT path FROM {name}_ok) THEN h.path ELSE first END AS path
  FROM {table} h JOIN {name}_c USING (hash))"""


def _holding(table: str, name: str) -> str:
    return f"""
{name}_h AS (SELECT query_id, hash, ordinal, count(DISTINCT no) AS c FROM pfound GROUP BY query_id, hash, ordinal),
{name} AS (
  SELECT t.query_id, row_number() OVER (PARTITION BY t.query_id ORDER BY rank) AS rank, t.hash, t.ordinal, path
  FROM {table} t LEFT JOIN pneeds n USING (query_id) LEFT JOIN {name}_h h ON h.query_id = t.query_id AND h.hash = t.hash AND h.ordinal = t.ordinal
  WHERE coalesce(n.n, 0) = coalesce(h.c, 0))"""


def _hybrid_sql(queries: str, meaning: bool, by_name: bool, where: str | None = None) -> str:
    widen = 4 if where else 1
    ctes = _keyword_sql(queries, 50 * widen) + ", kwp AS (SELECT query_id, rank, path, hash, ordinal FROM kw JOIN copies USING (hash))"
    ctes += ", pterms AS (SELECT * FROM parsed WHERE kind = 'phrase'), pneeds AS (SELECT query_id, count(*) AS n FROM pterms GROUP BY query_id)," + B.matches("pterms", name="pfound")
    lists = {"keyword": "kwp"}
    if meaning:
        ctes += "," + B.VECTORS + "," + B.nearest(50 * widen) + ", meanp AS (SELECT query_id, rank, path, hash, ordinal FROM mean JOIN copies USING (hash))"
        lists["meaning"] = "meanp"
    if by_name:
        ctes += "," + B.NAME_INDEX + "," + B.name_hits(20 * widen) + ", nmp AS (SELECT query_id, rank, path, hash, ordinal FROM nm)"
        lists["name"] = "nmp"
    for n in lists:
        if where:
            ctes += "," + _within(lists[n], where, f"w_{n}")
            lists[n] = f"w_{n}"
        if n != "keyword":
            ctes += "," + _holding(lists[n], f"h_{n}")
            lists[n] = f"h_{n}"
    shown = " UNION ALL ".join(f"SELECT query_id, hash, ordinal, path, {o} - rank AS o FROM {lists[n]}" for n, o in (("name", 0), ("keyword", 1000000), ("meaning", 2000000)) if n in lists)
    ctes += "," + _fused(lists) + f", shown AS (SELECT query_id, hash, ordinal, min_by(path, o) AS path FROM ({shown}) GROUP BY query_id, hash, ordinal)"
    return with_(ctes, "SELECT f.query_id, f.rank, s.path, f.hash, f.ordinal, f.score, f.found, coalesce(x.modified_secs, 0) AS modified_secs FROM fused f JOIN shown s USING (query_id, hash, ordinal) LEFT JOIN files x ON x.path = s.path")


@register("rrf_fuse", with_(_keyword_sql(B.WORDS, 50) + "," + B.VECTORS + "," + B.nearest(50) + "," + _fused({"keyword": "kw", "meaning": "mean"}), "SELECT query_id, hash, ordinal, score, rank FROM fused"))
def _(c: Corpus) -> DataFrame:
    c = c.narrowed(c.queries_words, meaning=True)
    lists = {"keyword": S.keyword_hits(c, c.queries_words, 50), "meaning": S.meaning_hits(c, c.queries_words, 50)}
    return fuse.fuse(lists, KEY).select("query_id", *KEY, "score", "rank")


@register("found_labels", "SELECT found, count(*) AS n FROM (" + _hybrid_sql(B.WORDS, True, True) + ") GROUP BY found")
def _(c: Corpus) -> DataFrame:
    return S.search(c.narrowed(c.queries_words, meaning=True), c.queries_words).groupBy("found").agg(F.count("*").alias("n"))


_FILTER = Filter(folders=("/corpus/en",), extensions=("txt", "md", "markdown"), modified_since=NOW - 366 * 86400)
_WHERE = f"starts_with(path, '/corpus/en/') AND doc_id % 8 <= 5 AND modified_secs >= {NOW - 366 * 86400}"

for _name, _q, _sql, _kw in (
    ("hybrid_search", "queries_words", _hybrid_sql(B.WORDS, True, False), {"by_name": False}),
    ("hybrid_with_names", "names", _hybrid_sql(_NAMES, True, True), {}),
    ("hybrid_filtered", "queries_words", _hybrid_sql(B.WORDS, True, True, _WHERE), {"f": _FILTER}),
    ("hybrid_phrase", "queries_phrase", _hybrid_sql(B.PHRASE, True, True), {}),
    ("search_words_only", "queries_words", _hybrid_sql(B.WORDS, False, True), {"meaning": False}),
):

    def _hybrid(c: Corpus, q: str = _q, kw: dict = _kw) -> DataFrame:
        queries = c.fixed_queries(NAME_QUERIES) if q == "names" else getattr(c, q)
        return S.search(c.narrowed(queries, kw.get("meaning", True)), queries, **kw)

    register(_name, _sql)(_hybrid)


# 7. results


@register("group_by_file", "SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY best) AS file_rank, n FROM (SELECT query_id, path, min(rank) AS best, count(*) AS n FROM (" + _hybrid_sql(B.WORDS, False, True) + ") GROUP BY query_id, path)")
def _(c: Corpus) -> DataFrame:
    return results.group_by_file(S.search(c.narrowed(c.queries_words), c.queries_words, meaning=False)).select("query_id", "path", "file_rank", F.size("passages").cast("long").alias("n"))


@register("locations", r"""WITH l AS (SELECT conv_id, turn FROM conversations) SELECT conv_id, turn, 'page ' || (turn + 1) AS paged, CASE WHEN turn = 0 THEN 'line 1' ELSE 'lines 1–' || (turn + 1) END AS lined FROM l""")
def _(c: Corpus) -> DataFrame:
    end, none = F.col("turn") + 1, F.lit(None).cast("long")
    return c.table("conversations").select("conv_id", "turn", results.location(end, F.lit(1).cast("long"), end).alias("paged"), results.location(none, F.lit(1).cast("long"), end).alias("lined"))


@register(
    "spans",
    r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}\p{Co}]+|[^\p{L}\p{N}\p{Co}]+') AS ps FROM documents),
e AS (SELECT doc_id, unnest(range(0, len(ps))) AS i, unnest(ps) AS t FROM p),
m AS (SELECT doc_id, i, t, list_contains(['the', 'und', 'de', 'that', 'ete'], lower(strip_accents(t))) AS marked FROM e),
g AS (SELECT *, sum(CASE WHEN marked THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m),
s AS (SELECT doc_id, k, marked, min(i) AS i, string_agg(t, '' ORDER BY i) AS text FROM g GROUP BY doc_id, k, marked)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS no, text, marked FROM s""",
)
def _(c: Corpus) -> DataFrame:
    marked = keyword.highlight(F.col("text"), F.array(*map(F.lit, _TERMS)))
    return c.table("documents").select("doc_id", F.posexplode(results.spans(marked)).alias("no", "s")).select("doc_id", F.col("no").cast("long").alias("no"), "s.text", "s.marked")


@register("name_and_folder", with_(B.FILES, r"SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_replace(path, '/[^/]*$', '') AS folder FROM docs"))
def _(c: Corpus) -> DataFrame:
    return c.listing.select("path", results.shown_name(F.col("path")).alias("name"), results.shown_folder(F.col("path")).alias("folder"))


@register("best_passage_per_file", "SELECT query_id, path, hash, ordinal, rank FROM (" + _hybrid_sql(B.PHRASE, True, True) + ") QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY rank) = 1")
def _(c: Corpus) -> DataFrame:
    return results.best_of_file(S.search(c.narrowed(c.queries_phrase, meaning=True), c.queries_phrase)).select("query_id", "path", *KEY, "rank")


@register("file_of_passage", with_(B.passages(), "SELECT p.hash, ordinal, path FROM passages p JOIN copies USING (hash)"))
def _(c: Corpus) -> DataFrame:
    return c.passages.join(results.copies(c.files), "hash").select(*KEY, "path")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL."""
    from . import more  # noqa: F401

    return QUERIES, SQL
