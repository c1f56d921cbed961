"""The inverted index: postings, lengths and counts of passages or paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def postings(units: DataFrame, key: list[str], text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """key, term, surface, tf and positions of every unit; with ``only``, of its terms (term) alone."""
    spread = units.select(*key, F.posexplode(F.arrays_zip(X.tokens(F.col(text)).alias("term"), X.surfaces(F.col(text)).alias("surface"))).alias("pos", "t"))
    spread = spread.select(*key, "t.term", "t.surface", F.col("pos").cast("long").alias("pos"))
    if only is not None:
        spread = spread.join(F.broadcast(only), "term", "left_semi")
    return spread.groupBy(*key, "term", "surface").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def lengths(units: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    return units.select(*key, F.size(X.surfaces(F.col(text))).cast("long").alias("dl"))


def stats(doc_lengths: DataFrame) -> DataFrame:
    """One row: units and their average length."""
    return doc_lengths.agg(F.count("*").alias("n_units"), F.avg("dl").alias("avgdl"))


def term_df(index: DataFrame, key: list[str]) -> DataFrame:
    """term, units with it and its occurrences."""
    return index.groupBy("term").agg(F.count_distinct(*key).alias("doc"), F.sum("tf").alias("cnt"))
