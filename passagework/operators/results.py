"""What a result shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import name, parent
from .keyword import END, START


def copies(files: DataFrame) -> DataFrame:
    """hash, the first path and the number of copies of each content."""
    return files.groupBy("hash").agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def location(page: Column, start: Column, end: Column) -> Column:
    return F.when(page.isNotNull(), F.concat(F.lit("page "), page.cast("string"))).when(start == end, F.concat(F.lit("line "), start.cast("string"))).otherwise(F.concat(F.lit("lines "), start.cast("string"), F.lit("–"), end.cast("string")))


def copies_note(n: Column) -> Column:
    return F.when(n > 1, F.concat(F.lit("(+"), (n - 1).cast("string"), F.lit(" identical)"))).otherwise(F.lit(""))


def spans(snippet: Column) -> Column:
    """An array of (text, marked) pieces of a highlighted text, empty ones left out."""
    outer = F.split(snippet, START, -1)

    def cut(part: Column, i: Column) -> Column:
        two = F.split(part, END, 2)
        marked = F.struct(F.get(two, 0).alias("text"), F.lit(True).alias("marked"))
        plain = F.struct(F.get(two, F.size(two) - 1).alias("text"), F.lit(False).alias("marked"))
        return F.when((i > 0) & (F.size(two) > 1), F.array(marked, plain)).otherwise(F.array(plain))

    return F.filter(F.flatten(F.transform(outer, cut)), lambda s: s["text"] != "")


def shown_name(path: Column) -> Column:
    return F.regexp_replace(name(path), r"\p{Cc}", "")


def shown_folder(path: Column) -> Column:
    return F.regexp_replace(parent(path), r"\p{Cc}", "")


def group_by_file(hits: DataFrame) -> DataFrame:
    """query_id, path, file_rank, passages (hash, ordinal, rank), best first; files in the order of their best."""
    grouped = hits.groupBy("query_id", "path").agg(F.min("rank").alias("best"), F.sort_array(F.collect_list(F.struct("rank", "hash", "ordinal"))).alias("passages"))
    order = W.partitionBy("query_id").orderBy("best")
    return grouped.withColumn("file_rank", F.row_number().over(order).cast("long"))


def best_of_file(hits: DataFrame) -> DataFrame:
    order = W.partitionBy("query_id", "path").orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
