"""A training corpus from raw documents, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame of the rows that go on; all but the last return the columns
of documents. ``run`` writes each stage's rows to the shared folder and rereads them for the next.

In every stage: a null text counts as an empty one; rows without a doc_id take part (quality rules, lines, encoding) or
are left alone (near duplicates, benchmark); repeated rows are judged alike, so that of equal texts under one doc_id
all stay or go; an empty table gives no rows; columns beyond those of documents go through, whatever their names, but
for the last stage, which names its own. Texts are worked on whole; one takes some 100 times its bytes in a task at
most. Ties: of similar lines and documents the one with the smallest doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm import bpe, decontaminate, jaccard, lines, quality
from passagework.llm.scratch import Scratch, table

#: Near duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule, or whose host is rejected, go."""
    return quality.keep_good(docs, Scratch(spark))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go; a document may keep an empty text, and stays."""
    return lines.without_repeats(docs, Scratch(spark))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return jaccard.keep_one(docs, Scratch(spark), SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"), Scratch(spark))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of each document, with the digests of ids and decoded bytes."""
    import public_tokenizers as tokenizers

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_texts(docs, path, tokenizers.PATTERN, keep=["doc_id", "lang", "source"], keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Merges in rank order can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = scratch.save(stage(spark, docs, sf_dir), f"{i}_{name}")
        if i:
            scratch.drop(f"{i - 1}_{STAGES[i - 1][0]}")
        docs = out
    return docs
