import random

from pyspark.sql import functions as F

from passagework.operators import contained, names, rank
from passagework.sources.corpus import Corpus
from passagework.sources.scratch import Scratch


def test_best_of_tasks_hold_the_best_of_all(spark, monkeypatch):
    """Scores of small blocks, cut often, equal those of the formula; of equal scores those of the least keys stay."""
    monkeypatch.setattr(rank, "SUMS", 8)
    draw = random.Random(5)
    rows = [(f"k{i:03}", draw.choice([5, 5, 9]), [(t, draw.choice([1, 1, 2]), 1) for t in range(3) if draw.random() < 0.4]) for i in range(300)]
    units = spark.createDataFrame(rows, "key string, dl long, hits array<struct<t: int, tf: int, n: int>>").repartition(3)
    of = rank.totals(units, 4)
    assert (of.n_units, of.avgdl) == (300, sum(r[1] for r in rows) / 300)
    assert of.doc.tolist() == [sum(t == h[0] for r in rows for h in r[2]) for t in range(4)]
    asked = [rank.Query(7, [(0, False, True), (1, False, True)], needed=2), rank.Query(9, [(2, True, True), (0, False, True)], n_phrases=1), rank.Query(11, [(3, False, True)])]
    got = rank.best(units, ["key"], asked, of, 10).orderBy("query_id", F.desc("score"), "key").collect()
    for q in asked:
        want = []
        for key, dl, hits in rows:
            held = {t: tf for t, tf, _ in hits}
            s = sum(rank.idf(300, int(of.doc[t])) * held[t] * 2.2 / (held[t] + 1.2 * (0.25 + 0.75 * dl / of.avgdl)) for t, _, _ in q.terms if t in held)
            if s and sum(phrase and t in held for t, phrase, _ in q.terms) == q.n_phrases:
                want.append((-round(s, 6), key, sum(t in held for t, _, _ in q.terms)))
        best = [(-r.score, r.key, r.matched) for r in got if r.query_id == q.query_id][:10]
        assert best == sorted(want)[:10]
        assert all(r.enough == (q.n_phrases > 0 or r.matched >= q.needed) for r in got if r.query_id == q.query_id)


def test_names_of_units_equal_names_of_postings(spark):
    paths = ["/c/alpha beta/gamma delta eps.txt", "/c/alpha/x.txt", "/c/beta/été-x.md", "/c/beta/ete.txt", "/c/z.txt", "/c/w.txt"]
    files = spark.createDataFrame([(p, h, h != "e") for p, h in zip(paths, "abcdef", strict=True)], "path string, hash string, has_words boolean")
    asked = ["alpha beta", "x", "c", "alpha beta gamma delta eps", "z", "été ete x", "ete-x w", "... missing"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    first = files.where("has_words").select("hash", F.lit(0).cast("long").alias("ordinal"))
    columns = ["query_id", "rank", "path", "hash", "ordinal", "score", "matched"]
    want = names.search(queries, files, first, 10).select(columns).collect()
    assert sorted(names.search_units(queries, files, 10, Scratch(spark)).select(columns).collect()) == sorted(want) and len(want) == 5


def test_items_are_found_at_every_place(spark):
    texts = ["", None, "short", "the item of twelve", "x\n\nxxthe item of twelve\nthe item of twelve", "an itemé of twelve", "the item of twelv", "aaaaaaaaaaaaaaaaab", "on\nto"]
    items = [(1, "the item of twelve"), (2, "itemé of"), (3, "short"), (4, "aaaaaaaaab"), (5, "to"), (6, "the item of twelve"), (7, "missing item")]
    rows = spark.createDataFrame([(str(i), "en", t) for i, t in enumerate(texts)], "hash string, lang string, text string")
    got = sorted((int(r["hash"]), r.query_id, r.line) for r in contained.holding(rows, items).collect())
    want = [(at, i, t[: t.find(item)].count("\n") + 1) for at, t in enumerate(texts) for i, item in items if t is not None and item in t]
    assert got == sorted(want)


def test_passages_of_a_narrowed_corpus_are_not_sorted_again(spark, tmp_path):
    """Copies are left out by their rows; what passages hold is written once and shuffled nowhere."""
    texts = ["a b c", "a b c", "b d " * 300, "b d " * 300, "", "aé b"]
    spark.createDataFrame([(8 * (i // 2 * 2 if i == 1 else i), t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = Corpus(spark, str(tmp_path))
    part = whole.narrowed(spark.createDataFrame([(1, "a b")], "query_id long, query string"))
    key = ["hash", "ordinal", "dl"]
    assert sorted(part.once.select(*key).collect()) == sorted(whole.lengths.select(*key).collect())
    plan = part.once._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort" not in plan
