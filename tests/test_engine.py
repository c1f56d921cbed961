"""Operators on small tables whose results can be told by hand."""

import math

import pytest
from pyspark.sql import functions as F

from passagework.functions import paths as P
from passagework.functions import text as X
from passagework.functions import vectors as V
from passagework.operators import chunk, fuse, keyword, maintenance, metrics, names, nearest, postings, results
from passagework.schema import DEFAULT_PATTERNS, Filter
from passagework.streaming import progress

KEY = ["hash", "ordinal"]


def one(df):
    return df.first()[0]


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "no int, v string").orderBy("no")
    return [r[0] for r in rows.select(f(F.col("v"))).collect()]


def passages(spark, texts):
    return spark.createDataFrame([(f"h{i}", 0, t) for i, t in enumerate(texts)], "hash string, ordinal long, text string")


def search(spark, texts, query, limit=10):
    p = passages(spark, texts + [f"the filler number{n}" for n in range(50)])
    index, sizes = postings.postings(p, KEY), postings.lengths(p, KEY)
    queries = spark.createDataFrame([(0, query)], "query_id long, query string")
    hits = keyword.search(queries, index, sizes, postings.term_df(index, KEY), postings.stats(sizes), KEY, limit)
    return [(r["hash"], r["score"], r["matched"]) for r in hits.orderBy("rank").collect()]


def test_chunks_share_words(spark):
    rows = spark.createDataFrame([("a", "1 2 3 4 5 6 7"), ("b", "x\ny z\n\nw"), ("c", " \n "), ("d", None)], "hash string, text string")
    got = {(r["hash"], r.ordinal): (r.start_line, r.end_line, r.text) for r in chunk.chunk_words(rows, 3, 1).collect()}
    assert got == {("a", 0): (1, 1, "1 2 3"), ("a", 1): (1, 1, "3 4 5"), ("a", 2): (1, 1, "5 6 7"), ("b", 0): (1, 2, "x y z"), ("b", 1): (2, 4, "z w")}
    with pytest.raises(ValueError):
        chunk.chunk_words(rows, 3, 3)


def test_weighted_chunks_equal_the_closed_form_where_words_weigh_one(spark):
    rows = spark.createDataFrame([(str(n), " ".join(map(str, range(n)))) for n in (0, 1, 19, 20, 21, 35, 36, 95)], "hash string, text string")
    same = chunk.chunk_tokens(rows, lambda w: [1] * len(w), 20, 5)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, chunk.chunk_words(rows, 20, 5).collect()))
    heavy = chunk.chunk_tokens(spark.createDataFrame([("a", "a bbbbbbbbb c d")], "hash string, text string"), lambda w: [len(x) for x in w], 4, 1)
    assert [r.text for r in heavy.orderBy("ordinal").collect()] == ["a", "bbbbbbbbb", "c d"]


def test_pages_number_on(spark):
    rows = spark.createDataFrame([("a", 1, "1 2 3 4"), ("a", 2, ""), ("a", 3, "5")], "hash string, page long, text string")
    assert [(r.ordinal, r.page, r.text) for r in chunk.chunk_pages(rows, 3, 1).orderBy("ordinal").collect()] == [(0, 1, "1 2 3"), (1, 1, "3 4"), (2, 3, "5")]


def test_text_functions(spark):
    assert column(spark, ["Résumé-ÀB2 straße"], X.tokens) == [["resume", "ab2", "straße"]]
    assert column(spark, ["a\u0001b\tc\r\n\u007f"], X.strip_controls) == ["ab\tc\r\n"]
    assert column(spark, ["The THE cat ... Cat"], X.distinct_words) == [["The", "cat"]]
    assert column(spark, ['say "a  b" and “c d” "open', '"..." x', 'a "b'], X.query_phrases) == [["a b", "c d"], [], []]
    assert column(spark, ['say "a  b" and "open', '"..." x'], X.query_words) == [["say", "and", "open"], ["x"]]
    assert column(spark, ["a\r\nb\n", "a\n\nb", ""], X.lines) == [["a", "b"], ["a", "", "b"], []]
    assert column(spark, ["(Berlin) in 1999, x12 Rome A2b4!"], X.names_and_numbers) == [["Berlin", "1999", "A2b4"]]
    assert column(spark, [" ".join(map(str, range(31))), "a  b"], X.opening) == [" ".join(map(str, range(30))) + " ...", "a b"]


def test_hostile_queries_never_fail(spark):
    import random

    r = random.Random(3)
    pieces = ['"', "“", "”", "OR", "AND", "NOT", "(", ")", "*", "^", "NEAR(a b)", "col:", "-", "\x00", "😀", "é", "a", "'", "--", ";", "\\", "%", "‏", "number3"]
    queries = ["".join(r.choice(pieces) + r.choice(["", " "]) for _ in range(r.randint(0, 12))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    p = passages(spark, ["a number3", "NOT or and"])
    index, sizes = postings.postings(p, KEY), postings.lengths(p, KEY)
    keyword.search(rows, index, sizes, postings.term_df(index, KEY), postings.stats(sizes), KEY, 5).collect()


def test_common_words_and_half_rule(spark):
    texts = ["the quick brown fox", "quick", "brown fox jumps high", "nothing here"]
    assert {h for h, _, _ in search(spark, texts, "the quick brown")} == {"h0", "h1", "h2"}
    assert {h for h, _, _ in search(spark, texts, "quick brown fox jumps high")} == {"h0", "h2"}
    assert len(search(spark, texts, "the filler")) == 10


def test_phrases_bind(spark):
    texts = ["alpha beta gamma", "beta alpha gamma", "alpha x beta", "INV-2026-0042 paid", "INV 0042 2026"]
    assert [h for h, _, _ in search(spark, texts, '"alpha beta" gamma')] == ["h0"]
    assert [h for h, _, _ in search(spark, texts, "INV-2026-0042")] == ["h3"]


def test_bm25_formula(spark):
    score = search(spark, ["apple apple pear", "pear plum"], "apple")[0][1]
    n, avgdl = 52, (3 + 2 + 50 * 3) / 52
    assert score == round(math.log((n - 1 + 0.5) / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avgdl)), 6)


def test_bm25_equals_sqlite(spark):
    import random
    import sqlite3

    try:
        db = sqlite3.connect(":memory:")
        db.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no FTS5")
    r = random.Random(1)
    texts = [" ".join(r.choice(["Ünder", "over", "été", "x1", "a-b", "the"] + [f"w{i}" for i in range(40)]) for _ in range(r.randint(3, 40))) for _ in range(200)]
    db.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", list(enumerate(texts)))
    p = passages(spark, texts)
    index, sizes = postings.postings(p, KEY), postings.lengths(p, KEY)
    terms = spark.createDataFrame([(0, "word", 0, "under"), (0, "word", 1, "w7"), (0, "word", 2, "a-b")], "query_id long, kind string, no long, text string")
    got = {r["hash"]: r.score for r in keyword.bm25(keyword.matches(terms, index, KEY), sizes, postings.stats(sizes), KEY).collect()}
    want = {f"h{i}": round(-s, 6) for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH '\"under\" OR \"w7\" OR \"a-b\"'")}
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 2e-6 for h in got)


def test_fusion_interleaves_and_labels(spark):
    def ranked(*ids):
        return spark.createDataFrame([(0, i, n) for n, i in enumerate(ids, 1)], "query_id long, id string, rank long")

    got = fuse.fuse({"keyword": ranked("a", "b"), "meaning": ranked("x", "y")}, ["id"]).orderBy("rank").collect()
    assert "".join(r.id for r in got) == "axby"
    got = fuse.fuse({"keyword": ranked("a", "b"), "meaning": ranked("b"), "name": ranked("a", "c")}, ["id"]).collect()
    assert {r.id: r.found for r in got} == {"a": "keyword", "b": "both", "c": "name"}


def test_filters_show_a_copy_inside(spark):
    files = spark.createDataFrame([("/a/x.txt", "h", 10), ("/b/x.txt", "h", 20), ("/a/y.md", "g", 5)], "path string, hash string, modified_secs long")
    hits = spark.createDataFrame([(0, 1, "/a/x.txt", "h", 0), (0, 2, "/a/y.md", "g", 0)], "query_id long, rank long, path string, hash string, ordinal long")
    assert [(r.rank, r.path) for r in fuse.within(hits, files, Filter(folders=("/b/",))).collect()] == [(1, "/b/x.txt")]
    assert [r.path for r in fuse.within(hits, files, Filter(extensions=("md",), modified_since=5)).collect()] == ["/a/y.md"]


def test_globs(spark):
    got = column(spark, ["ID_RSA.pub", "my Passwords.txt", "venv", "venv2", "~$doc", "a.key", "akey"], lambda c: P.matches(c, DEFAULT_PATTERNS))
    assert got == [True, True, True, False, True, True, False]
    paths = ["/r/a/.git/x.txt", "/r/node_modules/y.md", "/r/ok.txt", "/r/sub/.hid"]
    assert column(spark, paths, lambda c: P.hidden(c, "/r") | P.excluded(c, "/r", DEFAULT_PATTERNS, [])) == [True, True, False, True]
    assert column(spark, ["/r/ab/c", "/r/a/c", "/r/a"], lambda c: P.inside(c, "/r/a/")) == [False, True, False]
    assert column(spark, ["A.TXT", "b.Markdown", "c.pdf", "d.docx", "noext"], P.kind) == ["text", "text", "pdf", None, None]


def test_names_need_enough_words(spark):
    files = spark.createDataFrame([("/c/alpha beta/gamma delta eps.txt", "a"), ("/c/alpha/x.txt", "b"), ("/c/beta/y.txt", "c"), ("/c/z.txt", "d"), ("/c/w.txt", "e")], "path string, hash string")
    first = spark.createDataFrame([(h, 0) for h in "abcd"], "hash string, ordinal long")
    queries = spark.createDataFrame([(0, "alpha beta"), (1, "x"), (2, "c"), (3, "alpha beta gamma delta eps"), (4, "w")], "query_id long, query string")
    got = {(r.query_id, r["hash"]) for r in names.search(queries, files, first, 10).collect()}
    assert got == {(0, "a"), (1, "b"), (3, "a")}


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i == 0), float(i == 1), 0.1 * i]) for i in range(3)], "id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    got = nearest.knn(v, q, ["id"], 2).orderBy("rank").collect()
    assert [(r.id, r.distance) for r in got] == [(0, 0.0), (2, round(math.sqrt(1.04), 6))]
    with pytest.raises(Exception, match="must have 4 numbers"):
        nearest.put(v, v, v, ["id"], 4).collect()
    assert one(v.where("id = 0").select(V.unit(F.array(F.lit(0.0), F.lit(0.0))))) == [0.0, 0.0]


def test_snippet_and_spans(spark):
    text = " ".join(["x"] * 30 + ["the", "Été,"] + ["y"] * 30)
    rows = spark.createDataFrame([(text,), ("short",)], "text string")
    got = [r.snippet for r in keyword.with_snippet(rows, F.array(F.lit("ete"), F.lit("the")), 5).collect()]
    assert got[0] == "... x x x \u0002the\u0003 \u0002Été\u0003, ..." and got[1] == "short"
    marked = spark.createDataFrame([("a \u0002b\u0003c",), ("\u0002b\u0003",), ("",)], "t string").select(results.spans(F.col("t")).alias("s"))
    assert [[(s.text, s.marked) for s in r.s] for r in marked.collect()] == [[("a ", False), ("b", True), ("c", False)], [("b", True)], []]


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 1, False), (0, 2, True), (0, 11, True), (1, 1, False)], "query_id long, rank long, relevant boolean")
    totals = spark.createDataFrame([(0, 2), (1, 1), (2, 0)], "query_id long, total long")
    got = {r.query_id: (r.recall, r.mrr, r.ndcg) for r in metrics.scores(rows, totals).collect()}
    assert got == {0: (1.0, 0.5, round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6)), 1: (0, 0, 0), 2: (0, 0, 0)}


def test_problems_count_attempts(spark):
    kind = "path string, size long, modified_secs long, reason string"
    old = spark.createDataFrame([("a", 1, 1, "damaged", 1), ("b", 1, 1, "damaged", 1), ("c", 1, 1, "encrypted", 3)], kind + ", attempts int")
    new = spark.createDataFrame([("a", 1, 1, "crashed"), ("b", 2, 1, "damaged"), ("d", 1, 1, "cloud-only")], kind)
    got = {r.path: (r.reason, r.attempts) for r in maintenance.record_problems(old, new).collect()}
    assert got == {"a": ("crashed", 2), "b": ("damaged", 1), "c": ("encrypted", 3), "d": ("cloud-only", 1)}


def test_nearest_is_exact_over_batches(spark):
    import numpy as np

    from passagework.operators import nearest

    r = np.random.default_rng(5)
    v = np.round(r.normal(size=(500, 8)), 1)
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(500)], "id long, embedding array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = nearest.knn(rows, rows.where("id % 50 = 0").withColumnRenamed("id", "query_id"), ["id"], 7).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q in range(0, 500, 50):
        d = np.round(np.sqrt(((v - v[q]) ** 2).sum(1)), 6)
        want = sorted(range(500), key=lambda i, d=d: (d[i], i))[:7]
        assert [x.id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)] == want
    with pytest.raises(Exception, match="numbers"):
        nearest.knn(rows, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"), ["id"], 1).collect()


def test_tokens_and_spellings_stay_in_step(spark):
    p = passages(spark, ["İstanbul harbour plan", "Straße ÉTÉ z\u0307a"])
    got = {(x.term, x.surface) for x in postings.postings(p, KEY).collect()}
    assert {("istanbul", "istanbul"), ("harbour", "harbour"), ("plan", "plan"), ("straße", "straße"), ("ete", "été")} <= got
    assert all(t and s for t, s in got)


def test_tokens_are_counted_in_blocks(monkeypatch):
    import re

    offsets = lambda t: [m.span() for m in re.finditer(r" ?[a-z]{1,3}|\d", t)]
    weigh = chunk.weigh_by(offsets)
    words = ["abcdef", "ab", "12", "x"] * 5
    want = [2, 1, 2, 1] * 5
    assert weigh(words) == want
    monkeypatch.setattr(chunk, "COUNTED", 3)
    assert weigh(words) == want


def test_three_searches_are_judged(spark):
    from passagework.plans import evaluate as V
    from passagework.sources.embed import HashingModel

    docs = spark.createDataFrame([("a", "red house by the lake\nwith a green door"), ("b", "blue car on the road\nred house"), ("c", "nothing here " * 30)], "document string, text string")
    one = spark.createDataFrame([("written", "exact", "en", "a", 2, "green door", "green door"), ("written", "exact", "en", "b", 1, "blue car", "blue car")], "source string, kind string, language string, document string, line long, query string, answer string")
    two = one.limit(1).withColumn("source", F.lit("made")).withColumn("query", F.lit("missing words"))
    queries = V.join_sets(one, two)
    assert queries.count() == 3
    got = {(r.search, r.group): r for r in V.matrix(docs, queries, [HashingModel(64)], [(200, 30), (20, 5)]).collect() if r.config == "hashing@1 64 200/30"}
    assert got["words", "source:written"].recall == 1 and got["combined", "source:written"].mrr == 1 and got["words", "all"].queries == 3
    assert all(0 <= r.ndcg <= 1 for r in got.values())


def test_runs_are_two_stages_and_coalesce():
    from passagework.streaming.incremental import Runner

    log = []
    runner = Runner(lambda: (log.append("w"), [runner.ask() for _ in range(3)] if log == ["w"] else None), lambda: log.append("m"))
    assert runner.ask() == 4 and log == ["w", "m", "w", "m"]
    log.clear()
    stop = Runner(lambda: (log.append("w"), stop.pause("battery")), lambda: log.append("m"))
    assert stop.ask() == 1 and log == ["w"] and stop.paused == "battery"
    assert stop.resume() == 1 and log == ["w", "m"]


def test_samples_of_a_pace(spark):
    rows = [("s", t, d, 10) for t, d in ((0, 0), (0, 1), (1, 2), (1, 3), (5, 4))] + [("s", 6, 1, 20), ("s", 9, 4, 20)]
    got = progress.sampled(spark.createDataFrame(rows, "stage string, t long, done long, total long")).orderBy("t").collect()
    assert [(r.t, r.done, r.run) for r in got] == [(0, 0, 0), (1, 2, 0), (5, 4, 0), (6, 1, 1), (9, 4, 1)]


def test_postings_of_asked_terms_and_phrases_by_their_rarest_token(spark, tmp_path):
    """A corpus narrowed to its queries groups no other terms and writes its matches once; phrases of repeated and of
    common tokens are found where they stand."""
    from passagework.plans import search as S
    from passagework.sources.corpus import Corpus

    texts = ["the the cat sat on the mat", "the cat the cat on", "cat the sat", "on the mat the the", "of the of the zebra"]
    rows = [(8 * i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, '"the the"'), (2, '"of the zebra" cat'), (3, '"the cat" sat'), (4, '"missing cat"')]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    whole = Corpus(spark, str(tmp_path))
    part = whole.narrowed(queries)
    assert {r.term for r in part.index.select("term").distinct().collect()} == {"the", "of", "zebra", "cat", "sat"}
    assert part.narrowed(queries) is part
    hash_of = {r.hash: r.doc_id // 8 for r in whole.listing.collect()}
    got = [S.keyword_search(c, queries, 10).collect() for c in (part, whole)]
    assert sorted(map(tuple, got[0])) == sorted(map(tuple, got[1]))
    assert {(r.query_id, hash_of[r.hash]) for r in got[0]} == {(1, 0), (1, 3), (2, 4), (3, 0), (3, 1)}


def test_passages_without_lines_equal_those_with(spark):
    texts = ["", None, " \n\t ", "one", "a\r\nb  c\n\nd e\tf g", " ".join(map(str, range(37)))]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "hash string, text string")
    for size, overlap in ((3, 1), (7, 0), (200, 30)):
        whole = chunk.chunk_words(rows, size, overlap).select("hash", "ordinal", "text").collect()
        assert sorted(map(tuple, whole)) == sorted(map(tuple, chunk.chunk_texts(rows, size, overlap).collect()))
    # compiled as a whole: no function takes another one, and no filter makes the words twice
    plan = chunk.chunk_texts(rows)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("split(") == 1


def test_word_vectors_of_whole_tables_equal_the_columns(spark):
    texts = ["", "The the THE cat,", "... !!! ---", "Édition İstanbul ΣΑΣ été", "日本語 a b x  ½ Ⅷ", "don't e-mail 3.14 zebra zebra"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    slow = V.with_word_vector(rows, F.col("text")).select("id", "embedding").orderBy("id").collect()
    assert slow == V.word_vectors(rows, ["id"]).orderBy("id").collect()


def test_searches_of_a_narrowed_corpus_equal_those_of_postings(spark, tmp_path):
    """Matches are found in the passages' rows: marks, words of several tokens, phrases of one token and of repeated ones,
    terms that several queries share; ranks of equal scores follow the key."""
    from passagework.plans import search as S
    from passagework.sources.corpus import Corpus

    texts = ["Été ete été l'eau claire", "the the the cat l eau", "e-mail e mail cat", "cat été", "zebra cat the", "zebra cat the.", "", "filler " * 450 + "cat zebra"]
    texts += [f"other words number{i}" for i in range(60)]
    rows = [(8 * i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, "été cat"), (2, '"the the" cat'), (3, "l'eau"), (4, '"cat" e-mail'), (5, '"ete ete" "l eau"'), (6, "cat zebra the"), (7, '"zebra the"'), (8, "nothing here"), (9, "...")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    whole = Corpus(spark, str(tmp_path))
    part = whole.narrowed(queries)
    ids = part.units.orderBy("id").select(*KEY).collect()
    assert ids == sorted(ids) and len(ids) == part.passages.count()
    whole = whole.stored(f"{tmp_path}/stored")
    got, want = (sorted(map(tuple, S.keyword_search(c, queries, 10).collect())) for c in (part, whole))
    assert got == want and len({r[0] for r in got}) >= 6
    held = {r.term: (r.doc, r.cnt) for r in part.df.collect()}
    assert held == {r.term: (r.doc, r.cnt) for r in whole.df.collect() if r.term in held} and held["ete"] == (2, 4)
