"""The pipeline's stages, each against brute force on its own input, and the entry module without the subpackage."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passagework.llm import decontaminate, quality
from passagework.llm.scratch import Scratch

from .cases import TEXTS, empty, odd, prose
from .test_operators import brute_components, brute_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    near = prose(600, 100).split()
    more = [(50, " ".join(near)), (51, " ".join(near[:50] + ["x"] + near[51:])), (52, prose(601, 70) + " " + prose(50, 30) + " " + prose(602, 60)), (53, prose(603, 150)), (54, "too short")]
    extra = spark.createDataFrame([(i, t, "en", "s2", len(t)) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    odd(spark, clash=False).select(*COLUMNS).union(extra.select(*COLUMNS)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(50, 30)), (2, prose(51, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    scratch = Scratch(spark)

    def run(name, df):
        out = scratch.save(stages[name](spark, df, str(tmp_path)), name)
        return out, [(r.doc_id, r.text) for r in out.collect()] if "text" in out.columns else out.collect()

    kept = {(r.doc_id, r.n_words) for r in quality.judge(docs, Scratch(spark)).collect() if r.kept}
    one, rows = run("quality_rules", docs)
    assert one.columns == COLUMNS and {(i, len((t or "").split())) for i, t in rows} == kept
    two, after = run("line_dedup", one)
    gone = brute_lines(rows)
    want = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in rows if i is not None]
    assert two.columns == COLUMNS and Counter(x for x in after if x[0] is not None) == Counter(want)
    assert all(r.n_chars == len(r.text) for r in two.collect())
    three, after3 = run("ngram_jaccard", two)
    groups = brute_components([x for x in after if x[0] is not None], 5, 80)
    assert Counter(i for i, _ in after3 if i is not None) == Counter(i for i, _ in after if i is not None and groups[i][1] == i)
    four, after4 = run("decontamination", three)
    leaking = {r.doc_id for r in decontaminate.leaks(three, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()}
    assert leaking == {52} and Counter(after4) == Counter(x for x in after3 if x[0] not in leaking)
    five, last = run("byte_bpe", four)
    assert Counter((r.doc_id, r.decoded_sha256) for r in last) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in after4)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in whole) == Counter((r.doc_id, r.ids_sha256) for r in last)
    assert len(TEXTS) and {53} <= {r.doc_id for r in last}


def test_an_empty_table_and_clashing_columns(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([(1, prose(50, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = odd(spark).withColumn("a.b", F.lit("dot"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {r["a.b"] for r in out.collect()} == {"dot"}, name


def test_entry_has_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
