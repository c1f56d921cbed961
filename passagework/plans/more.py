"""Upkeep, evaluation, administration and progress: registered with the other queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import maintenance as M
from ..operators import chunk, contained, metrics, postings
from ..schema import DEFAULT_PATTERNS, FAILURES, MAX_MEGABYTES, MAX_PAGES, REASON_CODES, REASONS
from ..sources.corpus import KEY, Corpus
from ..streaming import progress
from . import search as S
from . import sqlbase as B
from .queries import _hybrid_sql, register, with_

_CODES = "[" + ", ".join(f"'{c}'" for c in REASON_CODES) + "]"
_FAILED = "(" + ", ".join(f"'{c}'" for c in FAILURES) + ")"
UPKEEP = B.FILES + f""",
scan_now AS (SELECT path, CASE WHEN doc_id % 13 = 0 THEN size + 1 ELSE size END AS size, modified_secs, doc_id % 17 = 0 AS cloud_only, hash, doc_id FROM docs WHERE doc_id % 11 <> 0),
index_files AS (SELECT path, size, modified_secs, hash FROM files WHERE doc_id % 7 <> 0),
index_problems AS (SELECT path, size, modified_secs, {_CODES}[doc_id % 11 + 1] AS reason, 1 + doc_id % 3 AS attempts FROM docs WHERE doc_id % 7 = 0)"""

_AGAIN = f"CASE WHEN reason IN ('cannot-open', 'cloud-only') THEN true WHEN reason IN {_FAILED} THEN attempts < 2 ELSE false END"
PLAN = UPKEEP + f""",
plan AS (
  SELECT s.path, s.size, s.modified_secs,
         CASE WHEN doc_id % 8 = 7 THEN 'unsupported' WHEN f.path IS NOT NULL THEN 'unchanged'
              WHEN cloud_only AND p.reason = 'cloud-only' THEN 'cloud-known' WHEN cloud_only THEN 'cloud-new'
              WHEN p.reason IS NOT NULL AND NOT ({_AGAIN}) THEN 'known-problem' ELSE 'read' END AS action
  FROM scan_now s LEFT JOIN index_files f ON f.path = s.path AND f.size = s.size AND f.modified_secs = s.modified_secs
  LEFT JOIN index_problems p ON p.path = s.path AND p.size = s.size AND p.modified_secs = s.modified_secs)"""


def _plan(c: Corpus) -> DataFrame:
    return M.change_plan(c.scan_now, c.index_files, c.index_problems)


@register("change_plan", with_(PLAN, "SELECT * FROM plan"))
def _(c: Corpus) -> DataFrame:
    return _plan(c)


@register("index_report", with_(PLAN, "SELECT " + ", ".join(f"count_if(action = '{a}') AS {a.replace('-', '_')}" for a in ("unsupported", "unchanged", "cloud-known", "cloud-new", "known-problem", "read")) + " FROM plan"))
def _(c: Corpus) -> DataFrame:
    return M.report(_plan(c))


@register("unchanged_files", with_(PLAN, "SELECT path FROM plan WHERE action = 'unchanged'"))
def _(c: Corpus) -> DataFrame:
    return _plan(c).where("action = 'unchanged'").select("path")


_READ = UPKEEP + ", fresh AS (SELECT path, size, modified_secs, hash FROM scan_now WHERE doc_id % 8 <> 7 AND NOT cloud_only)"


def _fresh(c: Corpus) -> DataFrame:
    return c.scan_now.where(P.kind(F.col("path")).isNotNull() & ~F.col("cloud_only")).select("path", "size", "modified_secs", "hash")


@register("put_file_merge", with_(_READ, "SELECT * FROM fresh UNION ALL SELECT * FROM index_files WHERE path NOT IN (SELECT path FROM fresh)"))
def _(c: Corpus) -> DataFrame:
    return M.put_files(c.index_files, _fresh(c))


@register("new_contents", with_(_READ, "SELECT DISTINCT hash FROM fresh WHERE hash NOT IN (SELECT hash FROM index_files)"))
def _(c: Corpus) -> DataFrame:
    return M.new_contents(_fresh(c), c.index_files)


@register("has_content", with_(_READ, "SELECT path, hash IN (SELECT hash FROM index_files) AS known FROM fresh"))
def _(c: Corpus) -> DataFrame:
    known = c.index_files.select("hash").distinct().withColumn("known", F.lit(True))
    return _fresh(c).join(known, "hash", "left").select("path", F.coalesce("known", F.lit(False)).alias("known"))


@register("purge_missing", with_(UPKEEP, "SELECT path FROM index_files WHERE starts_with(path, '/corpus/en/') AND path NOT IN (SELECT path FROM scan_now)"))
def _(c: Corpus) -> DataFrame:
    return M.purge(c.index_files, c.scan_now, "/corpus/en/")[1].select("path")


_LEFT = UPKEEP + ", kept AS (SELECT * FROM index_files WHERE NOT starts_with(path, '/corpus/en/') OR path IN (SELECT path FROM scan_now))"


@register("drop_orphans", with_(B.passages() + "," + _LEFT[len(B.FILES) + 1 :], "SELECT hash, ordinal FROM passages WHERE hash IN (SELECT hash FROM kept)"))
def _(c: Corpus) -> DataFrame:
    kept, _gone = M.purge(c.index_files, c.scan_now, "/corpus/en/")
    return M.drop_orphans(c.passages, kept).select(*KEY)


@register("known_paths_union", with_(UPKEEP, "SELECT path FROM index_files WHERE starts_with(path, '/corpus/de/') UNION SELECT path FROM index_problems WHERE starts_with(path, '/corpus/de/')"))
def _(c: Corpus) -> DataFrame:
    return M.known_paths(c.index_files, c.index_problems, "/corpus/de/")


@register(
    "record_problem",
    with_(
        UPKEEP
        + """, fresh AS (SELECT path, CASE WHEN doc_id % 2 = 0 THEN size ELSE size + 1 END AS size, modified_secs, 'damaged' AS reason FROM docs WHERE doc_id % 14 IN (0, 7) OR doc_id % 10 = 1)""",
        "SELECT f.path, f.size, f.modified_secs, f.reason, coalesce(p.attempts, 0) + 1 AS attempts FROM fresh f LEFT JOIN index_problems p USING (path, size, modified_secs) UNION ALL SELECT * FROM index_problems WHERE path NOT IN (SELECT path FROM fresh)",
    ),
)
def _(c: Corpus) -> DataFrame:
    d = F.col("doc_id")
    fresh = c.listing.where((d % 14).isin(0, 7) | (d % 10 == 1)).select("path", F.when(d % 2 == 0, F.col("size")).otherwise(F.col("size") + 1).alias("size"), "modified_secs", F.lit("damaged").alias("reason"))
    return M.record_problems(c.index_problems, fresh)


@register("parked_files", with_(UPKEEP, f"SELECT path FROM index_problems WHERE reason IN {_FAILED} AND attempts >= 2"))
def _(c: Corpus) -> DataFrame:
    return c.index_problems.where(M.parked(F.col("reason"), F.col("attempts"))).select("path")


@register("read_again", with_(UPKEEP, f"SELECT path, {_AGAIN} AS again FROM index_problems"))
def _(c: Corpus) -> DataFrame:
    return c.index_problems.select("path", M.read_again(F.col("reason"), F.col("attempts")).alias("again"))


@register("forget_failures", with_(UPKEEP, f"SELECT path, reason FROM index_problems WHERE reason NOT IN {_FAILED}"))
def _(c: Corpus) -> DataFrame:
    return M.forget_failures(c.index_problems).select("path", "reason")


@register("problems_by_cause", with_(UPKEEP, f"SELECT CASE WHEN reason IN {_FAILED} THEN 'failed' ELSE reason END AS cause, count(*) AS n FROM index_problems GROUP BY cause ORDER BY n DESC, cause"))
def _(c: Corpus) -> DataFrame:
    cause = F.when(M.is_failure(F.col("reason")), "failed").otherwise(F.col("reason"))
    return c.index_problems.groupBy(cause.alias("cause")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cause")


_OUTCOMES = "(SELECT * FROM (VALUES ('pages'), ('timeout'), ('truncated'), ('invalid')) a(answer), (VALUES (true), (false)) e(exit_ok), (VALUES (true), (false)) m(memory_limit), (VALUES (true), (false)) c(cpu_limit))"


@register("worker_verdict", f"SELECT *, CASE WHEN memory_limit THEN 'memory-limit' WHEN cpu_limit OR answer = 'timeout' THEN 'timed-out' WHEN answer = 'pages' AND exit_ok THEN 'ok' WHEN answer = 'pages' OR (answer = 'truncated' AND NOT exit_ok) THEN 'crashed' ELSE 'invalid-output' END AS verdict FROM {_OUTCOMES}")
def _(c: Corpus) -> DataFrame:
    rows = [(a, e, m, t) for a in ("pages", "timeout", "truncated", "invalid") for e in (True, False) for m in (True, False) for t in (True, False)]
    cases = c.spark.createDataFrame(rows, "answer string, exit_ok boolean, memory_limit boolean, cpu_limit boolean")
    return cases.withColumn("verdict", M.verdict(F.col("answer"), F.col("exit_ok"), F.col("memory_limit"), F.col("cpu_limit")))


@register("page_acceptance", r"SELECT conv_id, bool_and(length(trim(regexp_replace(text, '[^a-z]', '', 'g'))) < 40) AS blank, sum(strlen(text)) > 1200 OR count(*) > 6 AS too_large FROM conversations GROUP BY conv_id")
def _(c: Corpus) -> DataFrame:
    pages = c.table("conversations").groupBy("conv_id").agg(F.collect_list("text").alias("pages"))
    blank = F.forall("pages", lambda p: F.char_length(F.trim(F.regexp_replace(p, "[^a-z]", ""))) < 40)
    size = F.aggregate("pages", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p))
    return pages.select("conv_id", blank.alias("blank"), ((size > 1200) | (F.size("pages") > 6)).alias("too_large"))


@register(
    "bulk_purge_decision",
    with_(B.passages() + "," + _LEFT[len(B.FILES) + 1 :], "SELECT n, leaving, leaving > n * 0.02 AS bulk FROM (SELECT count(*) AS n, count_if(hash IN (SELECT hash FROM index_files EXCEPT SELECT hash FROM kept)) AS leaving FROM passages)"),
)
def _(c: Corpus) -> DataFrame:
    kept, gone = M.purge(c.index_files, c.scan_now, "/corpus/en/")
    left = gone.select("hash").distinct().join(kept.select("hash"), "hash", "left_anti").withColumn("_l", F.lit(True))
    counted = c.passages.join(left, "hash", "left").agg(F.count("*").alias("n"), F.count_if("_l").alias("leaving"))
    return counted.withColumn("bulk", M.bulk(F.col("leaving"), F.col("n")))


_STORED = """,
held AS (
  SELECT hash, ordinal, term, surface, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM toks GROUP BY hash, ordinal, term, surface),
kept AS (SELECT hash, ordinal, term, surface, CASE WHEN ordinal % 11 = 5 THEN tf + 1 ELSE tf END AS tf, positions FROM held WHERE ordinal % 7 <> 3
         UNION ALL SELECT hash, -1, term, surface, tf, positions FROM held WHERE ordinal % 13 = 6),
live AS (SELECT hash FROM files WHERE doc_id % 9 <> 4)"""


@register(
    "integrity_check",
    with_(
        B.INDEX + _STORED,
        """SELECT (SELECT count(*) FROM held) AS postings, (SELECT count(*) FROM held WHERE ordinal % 7 = 3) AS missing, (SELECT count(*) FROM kept WHERE ordinal = -1) AS extra,
        (SELECT count(*) FROM held WHERE ordinal % 7 <> 3 AND ordinal % 11 = 5) AS wrong, (SELECT count(*) FROM dl WHERE ordinal % 5 = 2 OR ordinal % 6 = 1) AS lengths,
        (SELECT count(*) FROM passages WHERE hash NOT IN (SELECT hash FROM live)) AS orphans""",
    ),
)
def _(c: Corpus) -> DataFrame:
    """A stored index with faults planted: postings lost, doubled under no passage and miscounted, lengths lost and wrong,
    files gone."""
    held = c.index.where("ordinal % 7 <> 3").withColumn("tf", F.when(F.col("ordinal") % 11 == 5, F.col("tf") + 1).otherwise(F.col("tf")))
    held = held.unionByName(c.index.where("ordinal % 13 = 6").withColumn("ordinal", F.lit(-1).cast("long")))
    sizes = c.lengths.where("ordinal % 5 <> 2").withColumn("dl", F.when(F.col("ordinal") % 6 == 1, F.col("dl") + 1).otherwise(F.col("dl")))
    return M.index_faults(c.passages, held, sizes, c.files.where("doc_id % 9 <> 4"), KEY)


@register("counts", with_(B.passages(), "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM contents) AS contents, (SELECT count(*) FROM passages) AS passages, (SELECT count(*) FROM embeddings) AS vectors"))
def _(c: Corpus) -> DataFrame:
    tables = {"files": c.files, "contents": c.contents, "passages": c.passages, "vectors": c.table("embeddings")}
    rows = None
    for name, t in tables.items():
        part = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows.agg(*[F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n) for n in tables])


# evaluation

_RELEVANT = B.passage_lines() + """,
answers AS (
  SELECT DISTINCT b.item_id AS query_id, d.hash, len(string_split(left(d.text, instr(d.text, b.text) - 1), chr(10))) AS line,
         array_to_string(list_filter(string_split_regex(b.text, '\\s+'), lambda x: x <> '')[1:3], ' ') AS answer
  FROM benchmark b JOIN docs d ON contains(d.text, b.text) WHERE doc_id % 8 <> 7),
relevant AS (
  SELECT a.query_id, p.hash, p.ordinal FROM answers a JOIN passages p ON p.hash = a.hash JOIN plines l ON l.hash = p.hash AND l.ordinal = p.ordinal
  WHERE a.line BETWEEN start_line AND end_line AND contains(p.text, answer)),
asked AS (SELECT DISTINCT b.item_id AS query_id, d.lang FROM benchmark b JOIN docs d ON contains(d.text, b.text) WHERE doc_id % 8 <> 7),
totals AS (SELECT item_id AS query_id, count(hash) AS total FROM benchmark LEFT JOIN relevant ON query_id = item_id GROUP BY item_id)"""


def _holding(c: Corpus) -> DataFrame:
    """query_id, hash, lang, line and answer of the documents that hold a query's item."""
    items = c.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item")).where("item is not null")
    items = items.withColumn("answer", F.array_join(F.slice(X.words(F.col("item")), 1, 3), " "))
    docs = c.documents.where(P.kind(F.col("path")).isNotNull()).select("hash", "lang", "text")
    held = contained.holding(docs, [(r.query_id, r.item) for r in items.select("query_id", "item").distinct().collect()])
    return held.join(F.broadcast(items), ["query_id", "item"]).select("query_id", "hash", "lang", "line", "answer")


def _relevant(c: Corpus, held: DataFrame) -> DataFrame:
    """query_id, hash and ordinal of the passages that cover the line of an item and hold its answer; ``held``: the rows
    of ``_holding``."""
    held = held.select("query_id", "hash", "line", "answer").distinct()
    # lines are counted in the few contents that hold an item
    p = chunk.chunk_words(c.contents.join(held.select("hash").distinct(), "hash", "left_semi"), c.size, c.overlap).select(*KEY, "start_line", "end_line", F.col("text").alias("passage"))
    covers = F.col("line").between(F.col("start_line"), F.col("end_line")) & F.contains("passage", "answer")
    return p.join(held, "hash").where(covers).select("query_id", *KEY)


@register("relevant_passages", with_(B.passages() + "," + _RELEVANT, "SELECT query_id, hash, ordinal FROM relevant"))
def _(c: Corpus) -> DataFrame:
    return _relevant(c, _holding(c))


@register("relevance_total", with_(B.passages() + "," + _RELEVANT, "SELECT query_id, total FROM totals"))
def _(c: Corpus) -> DataFrame:
    return _totals(c, _relevant(c, _holding(c)))


def _totals(c: Corpus, relevant: DataFrame) -> DataFrame:
    return c.table("benchmark").select(F.col("item_id").alias("query_id")).join(relevant, "query_id", "left").groupBy("query_id").agg(F.count("hash").alias("total"))


def _scores(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """query_id, recall, mrr and ndcg, and the rows of ``_holding`` that they were judged by."""
    c = c.narrowed(c.queries_words)
    hits, held = S.keyword_hits(c, c.queries_words, 10), _holding(c)
    if "scratch" not in c.__dict__:
        relevant = _relevant(c, held)
    else:
        held = c.scratch.save(held, "holding", small=True)
        relevant = c.scratch.save(_relevant(c, held), "relevant", small=True)
    return metrics.scores(metrics.judged(hits, relevant, KEY), _totals(c, relevant)), held


_SCORES = B.INDEX + "," + B.WORDS + "," + B.PARSE + "," + B.UNCOMMON + "," + B.matches() + "," + B.bm25() + "," + B.hits(10) + "," + _RELEVANT + """,
judged AS (SELECT k.query_id, k.rank, EXISTS (SELECT 1 FROM relevant r WHERE r.query_id = k.query_id AND r.hash = k.hash AND r.ordinal = k.ordinal) AS relevant FROM kw k),
per AS (SELECT query_id, max(CASE WHEN relevant THEN 1.0 ELSE 0.0 END) AS recall, min(CASE WHEN relevant THEN rank END) AS first, sum(CASE WHEN relevant THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END) AS dcg FROM judged GROUP BY query_id),
sc AS (
  SELECT t.query_id, coalesce(CAST(recall AS DOUBLE), 0.0) AS recall, round(coalesce(1.0 / CAST(first AS DOUBLE), 0.0), 6) AS mrr,
         round(CASE WHEN total > 0 THEN coalesce(dcg, 0.0) / list_sum(list_transform(range(1, least(total, 10) + 1), lambda i: 1.0 / log2(i + 1.0))) ELSE 0.0 END, 6) AS ndcg
  FROM totals t LEFT JOIN per USING (query_id))"""

for _metric, _column in (("recall_at_10", "recall"), ("mrr_at_10", "mrr"), ("ndcg_at_10", "ndcg")):

    def _one(c: Corpus, column: str = _column) -> DataFrame:
        return _scores(c)[0].select("query_id", column)

    register(_metric, with_(_SCORES, f"SELECT query_id, CAST({_column} AS DOUBLE) AS {_column} FROM sc"))(_one)

_GROUPED = _SCORES + """,
lg AS (SELECT query_id, list_distinct(list_concat(['all', 'kind:descriptive'], coalesce(list('language:' || lang) FILTER (lang IS NOT NULL), []), CASE WHEN count(lang) > 0 THEN ['script:latin'] ELSE [] END)) AS gs
  FROM totals LEFT JOIN asked USING (query_id) GROUP BY query_id),
grouped AS (SELECT g AS "group", count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM (SELECT query_id, unnest(gs) AS g FROM lg) JOIN sc USING (query_id) GROUP BY g)"""


def _grouped(c: Corpus) -> DataFrame:
    scored, held = _scores(c)
    langs = held.groupBy("query_id").agg(F.collect_set("lang").alias("langs"))
    scored = scored.join(langs, "query_id", "left")
    has = F.col("langs").isNotNull()
    labels = F.concat(F.array(F.lit("all"), F.lit("kind:descriptive")), F.when(has, F.transform("langs", lambda x: F.concat(F.lit("language:"), x))).otherwise(F.array().cast("array<string>")), F.when(has, F.array(F.lit("script:latin"))).otherwise(F.array().cast("array<string>")))
    return metrics.by_group(scored, labels)


@register("scores_by_group", with_(_GROUPED, "SELECT * FROM grouped"))
def _(c: Corpus) -> DataFrame:
    return _grouped(c)


_MINIMUMS = [("all", "recall", 0.3), ("all", "mrr", 0.99), ("language:en", "ndcg", 0.2), ("language:xx", "recall", 0.1)]


@register(
    "threshold_check",
    with_(
        _GROUPED + ', ml AS (SELECT "group", m AS metric, CASE m WHEN \'recall\' THEN recall WHEN \'mrr\' THEN mrr ELSE ndcg END AS value FROM grouped, (VALUES (\'recall\'), (\'mrr\'), (\'ndcg\')) t(m)), mins AS (SELECT * FROM (VALUES '
        + ", ".join(f"('{g}', '{m}', CAST({v} AS DOUBLE))" for g, m, v in _MINIMUMS)
        + ') v("group", metric, minimum))',
        "SELECT m.\"group\", m.metric, minimum, value, CASE WHEN value IS NULL THEN 'unknown group' WHEN value + 1e-9 >= minimum THEN 'ok' ELSE 'BELOW' END AS verdict FROM mins m LEFT JOIN ml ON ml.\"group\" = m.\"group\" AND ml.metric = m.metric",
    ),
)
def _(c: Corpus) -> DataFrame:
    return metrics.check(_grouped(c), c.spark.createDataFrame(_MINIMUMS, "`group` string, metric string, minimum double"))


_NAMED = r"""ln AS (SELECT doc_id, lang, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS t FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents)),
nw AS (SELECT doc_id, lang, line, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM (SELECT doc_id, lang, line, list_filter(list_transform(list_filter(string_split_regex(t, '\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda x: (regexp_matches(x, '[0-9]') AND length(x) >= 4) OR (regexp_matches(x, '^\p{Lu}') AND length(x) >= 5)) AS w FROM ln)),
uw AS (SELECT lower(word) AS k FROM nw GROUP BY lower(word) HAVING count(DISTINCT (doc_id, line)) = 1)"""


@register("exact_query_gen", with_(_NAMED, "SELECT doc_id, line, word FROM nw WHERE line % 2 = 1 AND lower(word) IN (SELECT k FROM uw) QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY i) = 1"))
def _(c: Corpus) -> DataFrame:
    rows = c.table("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    found = rows.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), F.posexplode(X.names_and_numbers(F.col("t"))).alias("i", "word")).withColumn("k", F.lower("word"))
    once = found.groupBy("k").agg(F.count_distinct("doc_id", "line").alias("n")).where("n = 1").select("k")
    own = found.where("line % 2 = 1").join(once, "k", "left_semi")
    return own.groupBy("doc_id", "line").agg(F.min_by("word", "i").alias("word"))


@register("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def _(c: Corpus) -> DataFrame:
    return c.table("events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


# administration


@register("folder_registry", "SELECT DISTINCT '/corpus/' || lang AS path FROM documents EXCEPT SELECT '/corpus/de'")
def _(c: Corpus) -> DataFrame:
    chosen = c.table("documents").select(F.concat(F.lit("/corpus/"), F.col("lang")).alias("path")).distinct()
    return chosen.join(c.spark.createDataFrame([("/corpus/de",)], "path string"), "path", "left_anti")


_EXCLUSIONS = ["/corpus/en/src1", "/corpus/en", "/elsewhere", "/corpus/fr/src2/x", "/corpus/end"]


@register("exclusion_registry", "SELECT e.path, EXISTS (SELECT 1 FROM (VALUES ('/corpus/en'), ('/corpus/fr')) f(folder) WHERE starts_with(e.path, folder || '/')) AS accepted FROM (VALUES " + ", ".join(f"('{p}')" for p in _EXCLUSIONS) + ") e(path)")
def _(c: Corpus) -> DataFrame:
    asked = c.spark.createDataFrame([(p,) for p in _EXCLUSIONS], "path string")
    return asked.withColumn("accepted", P.inside(F.col("path"), "/corpus/en") | P.inside(F.col("path"), "/corpus/fr"))


@register("pattern_list", "SELECT * FROM (VALUES ('*.key'), ('~$*'), ('venv')) v(pattern)")
def _(c: Corpus) -> DataFrame:
    given = c.spark.createDataFrame([([" *.key ", "", "~$*", "*.key", "a/b", " ", "venv"],)], "given array<string>")
    cut = F.array_distinct(F.filter(F.transform("given", lambda p: F.trim(p)), lambda p: p != ""))
    return given.select(F.explode(F.filter(cut, lambda p: P.pattern_fault(p).isNull())).alias("pattern"))


@register("limits_check", f"SELECT mb, pages, mb BETWEEN 1 AND {MAX_MEGABYTES} AND pages BETWEEN 1 AND {MAX_PAGES} AS ok FROM (VALUES (0, 10), (1, 1), (2048, 100000), (2049, 5), (5, 100001)) v(mb, pages)")
def _(c: Corpus) -> DataFrame:
    rows = c.spark.createDataFrame([(0, 10), (1, 1), (2048, 100000), (2049, 5), (5, 100001)], "mb int, pages int")
    return rows.withColumn("ok", F.col("mb").between(1, MAX_MEGABYTES) & F.col("pages").between(1, MAX_PAGES))


_DIMENSION = "(VALUES " + ", ".join("('{}', {}, '{}')".format(a, str(b).lower(), t.replace("'", "''")) for a, b, t in REASONS) + ") r(code, is_failure, text)"


@register("reason_dimension", f"SELECT * FROM {_DIMENSION}")
def _(c: Corpus) -> DataFrame:
    return M.reasons(c.spark)


@register("problem_view", with_(UPKEEP, rf"SELECT regexp_extract(path, '([^/]*)$', 1) AS name, regexp_replace(path, '/[^/]*$', '') AS folder, r.text, code, is_failure AS failed, is_failure AND attempts >= 2 AS parked FROM index_problems JOIN {_DIMENSION} ON code = reason"))
def _(c: Corpus) -> DataFrame:
    rows = c.index_problems.join(F.broadcast(M.reasons(c.spark)), F.col("code") == F.col("reason"))  # eleven rows
    return rows.select(P.name(F.col("path")).alias("name"), P.parent(F.col("path")).alias("folder"), "text", "code", F.col("is_failure").alias("failed"), M.parked(F.col("reason"), F.col("attempts")).alias("parked"))


@register("diagnostics_by_code", with_(UPKEEP, f"SELECT reason AS code, count(*) AS n, count_if(reason IN {_FAILED} AND attempts >= 2) AS parked FROM index_problems GROUP BY reason"))
def _(c: Corpus) -> DataFrame:
    return c.index_problems.groupBy(F.col("reason").alias("code")).agg(F.count("*").alias("n"), F.count_if(M.parked(F.col("reason"), F.col("attempts"))).alias("parked"))


_SYNC_CASES = ["/home/a/Dropbox/x", "/home/a/dropbox2/x", "C:\\Users\\a\\My Drive\\t", "/i/ICLOUDDRIVE", "/plain/folder"]


@register("synced_folders", "SELECT * FROM (VALUES (0, 'Dropbox'), (1, NULL), (2, 'Google Drive'), (3, 'iCloud Drive'), (4, NULL)) v(no, service)")
def _(c: Corpus) -> DataFrame:
    rows = c.spark.createDataFrame(list(enumerate(_SYNC_CASES)), "no int, path string")
    return rows.select("no", P.synced_by(F.col("path")).alias("service"))


@register("log_privacy", "SELECT event_id, event_type FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 300")
def _(c: Corpus) -> DataFrame:
    """The last lines of a log that are proven not to be private; others are left out."""
    lines = c.table("events").select(F.to_json(F.struct("event_id", "event_type", (F.col("event_type") != "click").alias("private"))).alias("line"))
    read = lines.select(F.from_json("line", "event_id long, event_type string, private boolean").alias("l")).select("l.*")
    return read.where(~F.coalesce("private", F.lit(True))).orderBy(F.desc("event_id")).limit(300).select("event_id", "event_type")


@register("modified_secs", with_(B.FILES, "SELECT d.doc_id, coalesce(f.modified_secs, 0) AS modified_secs FROM docs d LEFT JOIN files f ON f.path = d.path"))
def _(c: Corpus) -> DataFrame:
    return c.listing.select("doc_id", "path").join(c.files.select("path", "modified_secs"), "path", "left").select("doc_id", F.coalesce("modified_secs", F.lit(0)).alias("modified_secs"))


@register("model_name", "SELECT * FROM (VALUES ('small@abc 384', 'small@abc'), ('a b@1 64', 'a b@1')) v(stored, model)")
def _(c: Corpus) -> DataFrame:
    rows = c.spark.createDataFrame([("small@abc 384",), ("a b@1 64",)], "stored string")
    return rows.withColumn("model", F.regexp_replace("stored", " [^ ]*$", ""))


@register("default_patterns", "SELECT DISTINCT lower(p) AS pattern FROM (VALUES " + ", ".join("('" + p.replace("'", "''") + "')" for p in DEFAULT_PATTERNS) + ") v(p)")
def _(c: Corpus) -> DataFrame:
    return c.spark.createDataFrame([(p.lower(),) for p in DEFAULT_PATTERNS], "pattern string")


# progress

_LOG = "log AS (SELECT event_type AS stage, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY event_type) AS total FROM events)"


def _log(c: Corpus) -> DataFrame:
    e = c.table("events")
    own = W.partitionBy("event_type")
    return e.select(F.col("event_type").alias("stage"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "event_id", F.row_number().over(own.orderBy("ts", "event_id")).cast("long").alias("done"), F.count("*").over(own).alias("total"))


_PACE = _LOG + """,
since AS (SELECT *, min(done) OVER w AS from_done, min(t) OVER w AS from_t FROM log WINDOW w AS (PARTITION BY stage ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)),
pace AS (SELECT stage, event_id, done, total, CASE WHEN t - from_t >= 3 AND done > from_done THEN (done - from_done) / CAST(t - from_t AS DOUBLE) END AS rate FROM since)"""


@register("pace_window", with_(_PACE, "SELECT stage, event_id, round(rate, 6) AS rate FROM pace"))
def _(c: Corpus) -> DataFrame:
    return progress.pace(_log(c), 3600).select("stage", "event_id", F.round("rate", 6).alias("rate"))


@register("eta", with_(_PACE, "SELECT stage, event_id, CASE WHEN rate > 0 THEN CAST(ceil(round((total - done) / rate, 6)) AS BIGINT) END AS seconds_left FROM pace"))
def _(c: Corpus) -> DataFrame:
    paced = progress.pace(_log(c), 3600)
    return paced.select("stage", "event_id", progress.seconds_left(F.col("done"), F.col("total"), F.col("rate")).alias("seconds_left"))


@register(
    "attempt_streaks",
    """WITH a AS (SELECT user_id, event_id, value > 50 AS big, lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, ts FROM events),
g AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> big THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS attempts FROM g""",
)
def _(c: Corpus) -> DataFrame:
    e = c.table("events").select("user_id", "event_id", "ts", (F.col("value") > 50).alias("state"))
    return progress.attempts(e, "user_id", "state", ["ts", "event_id"]).select("user_id", "event_id", "attempts")


_POWER = "(SELECT * FROM (VALUES (NULL), (true), (false)) b(before), (VALUES (NULL), (true), (false)) n(now), (VALUES (true), (false)) e(enabled), (VALUES (NULL), ('battery'), ('you')) p(paused))"


@register("power_steps", f"SELECT *, CASE WHEN paused = 'battery' THEN CASE WHEN NOT enabled OR coalesce(now = false, false) THEN 'resume' ELSE 'nothing' END WHEN enabled AND paused IS NULL AND coalesce(now, false) AND NOT coalesce(before, false) THEN 'pause' ELSE 'nothing' END AS step FROM {_POWER}")
def _(c: Corpus) -> DataFrame:
    three = (None, True, False)
    rows = [(b, n, e, p) for b in three for n in three for e in (True, False) for p in (None, "battery", "you")]
    cases = c.spark.createDataFrame(rows, "before boolean, now boolean, enabled boolean, paused string")
    return cases.withColumn("step", progress.power_step(F.col("before"), F.col("now"), F.col("enabled"), F.col("paused")))


_DUE = "(SELECT * FROM (VALUES (true), (false), (NULL)) a(agreed), (VALUES (NULL), (1000), (90000)) s(success), (VALUES (NULL), (89000), (97000)) t(attempt))"


@register("update_due", f"SELECT *, coalesce(agreed, false) AND (success IS NULL OR 100000 - success >= 86400) AND (attempt IS NULL OR 100000 - attempt >= 3600) AS due FROM {_DUE}")
def _(c: Corpus) -> DataFrame:
    rows = [(a, s, t) for a in (True, False, None) for s in (None, 1000, 90000) for t in (None, 89000, 97000)]
    cases = c.spark.createDataFrame(rows, "agreed boolean, success int, attempt int")
    return cases.withColumn("due", progress.update_due(F.col("agreed"), F.col("success"), F.col("attempt"), F.lit(100_000)))


# Python on the executors; no SQL


@register("decode_text", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(c: Corpus) -> DataFrame:
    from ..sources.files import decode_text

    docs = c.table("documents")
    wide = F.encode("text", "UTF-16LE")
    latin = F.col("text").rlike(r"\A[\x01-\x7f\xa0-\xff]*\z")
    marked = F.when((F.char_length("text") < 16) | ~latin, F.concat(F.unhex(F.lit("FFFE")), wide)).otherwise(wide)  # can't be told without
    # a text that the code page can't hold is not written in it
    coded = F.when(F.col("doc_id") % 3 == 0, marked).when((F.col("doc_id") % 3 == 1) & latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return docs.select("doc_id", decode_text(coded).alias("text")).select("doc_id", F.sha2("text", 256).alias("hash"))


@register("scale_synthetic")
def _(c: Corpus) -> DataFrame:
    from ..sources.synthetic import passages

    return passages(c.spark, 1_000)


@register("chunk_tokens")
def _(c: Corpus) -> DataFrame:
    from ..operators.chunk import chunk_tokens

    return chunk_tokens(c.contents, lambda words: [-(-len(w) // 3) for w in words], 350, 50)


@register("embed_udf")
def _(c: Corpus) -> DataFrame:
    from ..sources.embed import HashingModel, embed

    return embed(c.passages.select(*KEY, "text"), HashingModel(64), KEY)
