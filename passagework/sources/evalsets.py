"""Evaluation sets and thresholds from files, and score tables as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import one_line

LANGUAGES = 3


def read_articles(spark: SparkSession, path: str, language: str, number: int) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, queries) of a question set in JSON: data[].paragraphs[].{context, qas[].{question, answers[].text}}.
    Article i is a document of language number i mod 3; ``number`` is this file's."""
    data = spark.read.json(path, multiLine=True).select(F.posexplode("data").alias("article", "a"))
    parts = data.select("article", F.posexplode("a.paragraphs").alias("paragraph", "p"))
    own = (F.col("article") % LANGUAGES) == number
    paragraphs = parts.where(own).select("article", (F.col("paragraph") + 1).cast("long").alias("line"), F.lit(language).alias("language"), one_line(F.col("p.context")).alias("text"))
    asked = parts.select("article", (F.col("paragraph") + 1).cast("long").alias("line"), F.posexplode("p.qas").alias("no", "q"))
    queries = asked.select("article", "line", "no", F.lit(language).alias("language"), F.col("q.question").alias("query"), one_line(F.element_at("q.answers", 1)["text"]).alias("answer"), own.alias("own"))
    return paragraphs, queries


def other_language(own: F.Column) -> F.Column:
    """The language that asks about a document of language number ``own`` across languages."""
    return F.when(own == 0, F.lit(2)).otherwise(F.lit(0))


def read_queries(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """kind, language, document, answer, query and line of a tab-separated file with # comments. The answer must stand
    on exactly one line of its document (document, text); any other row is an error."""
    rows = spark.read.csv(path, sep="\t", comment="#", quote="", schema="kind string, language string, document string, answer string, query string")
    spread = documents.select("document", F.posexplode(F.split("text", "\n", -1)).alias("at", "t")).select("document", (F.col("at") + 1).cast("long").alias("line"), one_line(F.col("t")).alias("t"))
    found = rows.join(spread, (rows.document == spread.document) & F.contains(spread.t, rows.answer), "left").groupBy(*[rows[c] for c in rows.columns]).agg(F.count("line").alias("n"), F.min("line").alias("line"))
    line = F.when(F.col("n") == 1, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("the answer isn't on exactly one line: "), F.coalesce("answer", F.lit("")))).cast("long"))
    return found.select("kind", "language", "document", "answer", "query", line.alias("line"))


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """search, group, metric and minimum, separated by white space; # starts a comment."""
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("v")).where("v <> ''")
    parts = F.split("v", r"\s+")
    return rows.select(parts[0].alias("search"), parts[1].alias("group"), F.element_at(F.split(parts[2], "@"), 1).alias("metric"), parts[3].cast("double").alias("minimum"))


def markdown(scores: DataFrame) -> str:
    """A table of grouped scores in percent with one decimal."""
    rows = scores.orderBy("group").collect()
    head = "| group | queries | recall@10 | MRR@10 | nDCG@10 |\n|---|---:|---:|---:|---:|"
    return "\n".join([head, *(f"| {r['group']} | {r.queries} | {100 * r.recall:.1f} | {100 * r.mrr:.1f} | {100 * r.ndcg:.1f} |" for r in rows)])
