"""Retrieval metrics over judged rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 10


def judged(hits: DataFrame, relevant: DataFrame, key: list[str]) -> DataFrame:
    """query_id, rank and relevant (boolean) of every hit."""
    return hits.join(relevant.select("query_id", *key).distinct().withColumn("_r", F.lit(True)), ["query_id", *key], "left").select("query_id", "rank", F.coalesce("_r", F.lit(False)).alias("relevant"))


def ideal(total: Column, top: int = TOP) -> Column:
    n = F.least(total, F.lit(top)).cast("int")
    return F.when(total > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))).otherwise(0.0)


def scores(rows: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, recall, mrr and ndcg at ``top``. ``totals``: (query_id, total) of every query, 0 where none."""
    hit = F.col("relevant") & (F.col("rank") <= top)
    per = rows.groupBy("query_id").agg(F.max(F.when(hit, 1.0).otherwise(0.0)).alias("recall"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(hit, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    all_queries = totals.join(per, "query_id", "left")
    best = ideal(F.col("total"), top)
    return all_queries.select("query_id", F.coalesce("recall", F.lit(0.0)).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.when(best > 0, F.coalesce("dcg", F.lit(0.0)) / best).otherwise(0.0), 6).alias("ndcg"))


def by_group(scored: DataFrame, groups: Column) -> DataFrame:
    """Means for overlapping groups: ``groups`` is an array of labels of each query."""
    return scored.select(F.explode(groups).alias("group"), "recall", "mrr", "ndcg").groupBy("group").agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def check(grouped: DataFrame, minimums: DataFrame) -> DataFrame:
    """group, metric, minimum, value and verdict; a group that wasn't scored is an error of its own."""
    long = grouped.unpivot("group", ["recall", "mrr", "ndcg"], "metric", "value")
    rows = minimums.join(long, ["group", "metric"], "left")
    return rows.select("group", "metric", "minimum", "value", F.when(F.col("value").isNull(), "unknown group").when(F.col("value") + 1e-9 >= F.col("minimum"), "ok").otherwise("BELOW").alias("verdict"))
