"""Reciprocal rank fusion and the combined search's filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import admits
from ..schema import RRF_K, Filter

LISTS = ("keyword", "meaning", "name")


def fuse(lists: dict[str, DataFrame], key: list[str], k: int = RRF_K) -> DataFrame:
    """query_id, key, score, found and rank, from lists of (query_id, key, rank). Equal scores keep the order of first
    appearance: keyword, meaning, name."""
    parts = [lists[n].select("query_id", *key, F.lit(i).alias("list"), F.col("rank").cast("long").alias("rank")) for i, n in enumerate(LISTS) if n in lists]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    has = lambda i: F.max(F.col("list") == i)
    grouped = rows.groupBy("query_id", *key).agg(F.round(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))), 6).alias("score"), F.min(F.col("list") * 1_000_000 + F.col("rank")).alias("first"), has(0).alias("kw"), has(1).alias("mean"))
    found = F.when(F.col("kw") & F.col("mean"), "both").when(F.col("kw"), "keyword").when(F.col("mean"), "meaning").otherwise("name")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "first")
    return grouped.select("query_id", *key, "score", found.alias("found"), F.row_number().over(order).cast("long").alias("rank"))


def within(hits: DataFrame, files: DataFrame, f: Filter) -> DataFrame:
    """Hits (query_id, hash, path, ...) from files that the filter admits; a hit whose own path isn't is shown as the
    first copy that is, or left out. Ranks close up."""
    if f.empty:
        return hits
    ok = files.where(admits(F.col("path"), F.col("modified_secs"), f)).select("hash", F.col("path").alias("_p"))
    copy = ok.groupBy("hash").agg(F.min("_p").alias("_first"))
    own = ok.select(F.col("_p").alias("path"), F.lit(True).alias("_own"))
    kept = hits.join(copy, "hash").join(own, "path", "left").withColumn("path", F.when(F.col("_own"), F.col("path")).otherwise(F.col("_first"))).drop("_own", "_first")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")).cast("long"))


def holding(hits: DataFrame, phrase_matches: DataFrame, n_phrases: DataFrame, key: list[str]) -> DataFrame:
    """Hits whose passage holds every phrase of the query. ``phrase_matches``: (query_id, no, key); ``n_phrases``:
    (query_id, n_phrases)."""
    has = phrase_matches.groupBy("query_id", *key).agg(F.count_distinct("no").alias("c"))
    rows = hits.join(n_phrases, "query_id", "left").join(has, ["query_id", *key], "left")
    kept = rows.where(F.coalesce("n_phrases", F.lit(0)) == F.coalesce("c", F.lit(0))).drop("n_phrases", "c")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")).cast("long"))
