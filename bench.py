"""Times the headline queries once each and prints one JSON line. BENCH_SF_DIR: tables; BENCH_CPUS: threads."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from passagework.plans import queries as engine
from passagework.plans import search as S
from passagework.schema import PROBLEMS
from passagework.sources import synthetic
from passagework.sources.corpus import KEY, Corpus
from passagework.operators import keyword, maintenance, postings

SINGLE = ["chunk_words_200_30", "postings", "dedup_contents", "knn_l2", "name_search", "change_plan", "exact_query_gen", "integrity_check"]


#: Passages and queries of the scale run; BENCH_SCALE=0 leaves it out.
PASSAGES, QUERIES, QUERY_WORDS = 250_000, 50, 6


def scale_run(spark: SparkSession, run) -> dict:
    """A synthetic index of Zipf words: passages a second, a batch of queries, and an unchanged listing."""
    n = int(os.environ.get("BENCH_SCALE", PASSAGES))
    if not n:
        return {}
    with tempfile.TemporaryDirectory() as store:
        start = time.time()
        synthetic.passages(spark, n).selectExpr("cast(file as string) AS hash", "ordinal", "text").write.parquet(f"{store}/passages")
        passages = spark.read.parquet(f"{store}/passages")
        made = time.time() - start
        start = time.time()
        postings.postings(passages, KEY).write.parquet(f"{store}/index")
        index = spark.read.parquet(f"{store}/index")
        postings.lengths(passages, KEY).write.parquet(f"{store}/lengths")
        sizes = spark.read.parquet(f"{store}/lengths")
        postings.term_df(index, KEY).write.parquet(f"{store}/df")
        built = time.time() - start
        asked = synthetic.passages(spark, QUERIES, seed=11).selectExpr("file * 25 + ordinal AS query_id", f"array_join(slice(split(text, ' '), 1, {QUERY_WORDS}), ' ') AS query")
        start = time.time()
        run(keyword.search(asked, index, sizes, spark.read.parquet(f"{store}/df"), postings.stats(sizes), KEY, 10))
        searched = time.time() - start
        listing = passages.selectExpr("concat('/scale/', hash, '.txt') AS path", "cast(1 as bigint) AS size", "cast(1 as bigint) AS modified_secs", "hash").dropDuplicates(["path"])
        listing.write.parquet(f"{store}/files")
        files = spark.read.parquet(f"{store}/files")
        none = spark.createDataFrame([], PROBLEMS)
        start = time.time()
        run(maintenance.change_plan(files.selectExpr("path", "size", "modified_secs", "false AS cloud_only"), files, none))
        unchanged = time.time() - start
    return {"passages": n, "made_sec": round(made, 2), "index_sec": round(built, 2), "passages_per_sec": round(n / built, 1), "keyword_batch_sec": round(searched, 2), "keyword_ms_a_query": round(1000 * searched / QUERIES, 1), "unchanged_sec": round(unchanged, 2)}


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.time()
        work()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    spark.range(1000).selectExpr("sum(id)").collect()
    plans = engine.load()[0]
    for name in SINGLE:
        timed(name, lambda name=name: run(plans[name](spark, folder)))
    with tempfile.TemporaryDirectory() as store:
        built: list[Corpus] = []
        timed("index_build", lambda: built.append(Corpus(spark, folder).stored(store)))
        c = built[0]
        n = c.queries_words.count()
        passages = c.passages.count()
        timed("keyword_batch", lambda: run(keyword.search(c.queries_words, c.index, c.lengths, c.df, c.stats, KEY, 10)))
        timed("phrase_batch", lambda: run(keyword.search(c.queries_phrase, c.index, c.lengths, c.df, c.stats, KEY, 10)))
        timed("hybrid_batch", lambda: run(S.search(c, c.queries_words)))
    scale = scale_run(spark, run)
    print("scale", scale, file=sys.stderr, flush=True)
    sf = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None, "batch_queries": n, "passages": passages, "passages_per_sec": round(passages / took["index_build"], 1), "keyword_queries_per_sec": round(n / took["keyword_batch"], 2), "hybrid_queries_per_sec": round(n / took["hybrid_batch"], 2), "scale": scale}))


if __name__ == "__main__":
    main()
