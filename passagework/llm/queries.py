"""Queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bayes, bpe, chains, decontaminate, jaccard, lines, quality, shards, substrings, warc
from .scratch import Scratch, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substring_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.repeated_passages(table(spark, sf_dir, "documents"), Scratch(spark))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), Scratch(spark))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"), Scratch(spark))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), Scratch(spark))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_texts(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), Scratch(spark))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_to_warc(table(spark, sf_dir, "pages"), Scratch(spark))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_substring_chains": op2_substring_chains,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_line_dedup": op4_line_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_sharding": op8_sharding,
        "op9_warc": op9_warc,
        "op10_quality_classifier": op10_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    from . import sql

    return sql.oracle_sql()
