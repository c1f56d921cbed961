"""Queries against their SQL in DuckDB, on the smallest tables: one of each family (the driver runs them all)."""

import os

import pytest

from passagework.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "benchmark", "conversations", "events"]
NAMES = ["chunk_lines", "parse_query", "keyword_phrase", "snippet", "knn_l2", "name_search", "hybrid_filtered", "change_plan", "record_problem", "scores_by_group", "exact_query_gen", "pace_window", "pattern_list", "eta"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    cut = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(cut(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    plans, sql = queries.load()
    got = plans[name](spark, DATA)
    want = duck.execute(sql[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_every_query_has_a_name_of_its_own():
    plans, sql = queries.load()
    assert set(sql) <= set(plans) and len(plans) > 90


@pytest.mark.parametrize("name", ["mean_pool", "strip_controls", "spans"])
def test_whole_tables_equal_their_sql(spark, duck, name):
    test_query_equals_its_sql(spark, duck, name)


def test_mean_pool_reads_every_row(spark):
    got = queries.load()[0]["mean_pool"](spark, DATA).collect()
    assert sum(r.n for r in got) == spark.read.parquet(f"{DATA}/embeddings.parquet").count() > 200


def test_texts_are_cleaned_and_marked_to_their_ends(spark, tmp_path):
    text = "filler " * 100 + "a\u0007b the end"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plans = queries.load()[0]
    assert "ab the end" in plans["strip_controls"](spark, str(tmp_path)).first().text
    spans = plans["spans"](spark, str(tmp_path)).orderBy("no").collect()
    assert "".join(r.text for r in spans) == text and [r.text for r in spans if r.marked] == ["the"]
