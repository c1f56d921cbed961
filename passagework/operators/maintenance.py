"""Upkeep of an index as whole-table plans: what a scan changes, merges, purges and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import kind
from ..schema import ATTEMPTS_BEFORE_PARKING, BULK_SHARE, FAILURES, REASON_CODES, REASONS


def is_failure(reason: Column) -> Column:
    return reason.isin(*FAILURES)


def parked(reason: Column, attempts: Column) -> Column:
    return is_failure(reason) & (attempts >= ATTEMPTS_BEFORE_PARKING)


def read_again(reason: Column, attempts: Column) -> Column:
    """Whether an unchanged file that wasn't indexed is tried again."""
    return F.when(reason.isin("cannot-open", "cloud-only"), True).when(is_failure(reason), ~parked(reason, attempts)).otherwise(False)


def change_plan(scan: DataFrame, files: DataFrame, problems: DataFrame) -> DataFrame:
    """path, size, modified_secs and action of every scanned file: unsupported, unchanged, cloud-known, cloud-new,
    known-problem or read. ``scan``: (path, size, modified_secs, cloud_only)."""
    stored = files.select("path", F.col("size").alias("_s"), F.col("modified_secs").alias("_m"))
    faults = problems.where(F.col("reason").isin(*REASON_CODES)).select("path", "size", "modified_secs", "reason", "attempts")
    rows = scan.join(stored, "path", "left").join(faults, ["path", "size", "modified_secs"], "left")
    same = (F.col("_s") == F.col("size")) & (F.col("_m") == F.col("modified_secs"))
    action = (
        F.when(kind(F.col("path")).isNull(), "unsupported")
        .when(F.coalesce(same, F.lit(False)), "unchanged")
        .when(F.col("cloud_only") & (F.coalesce("reason", F.lit("")) == "cloud-only"), "cloud-known")
        .when(F.col("cloud_only"), "cloud-new")
        .when(F.col("reason").isNotNull() & ~read_again(F.col("reason"), F.col("attempts")), "known-problem")
        .otherwise("read")
    )
    return rows.select("path", "size", "modified_secs", action.alias("action"))


def put_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """``files`` with ``new`` rows in place of those of the same path."""
    return files.join(new.select("path"), "path", "left_anti").unionByName(new.select(*files.columns))


def new_contents(new: DataFrame, files: DataFrame) -> DataFrame:
    """Hashes that no indexed file has; only their passages are written."""
    return new.select("hash").distinct().join(files.select("hash"), "hash", "left_anti")


def purge(files: DataFrame, seen: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(files that stay, files that leave): those under ``prefix`` that the scan did not see leave."""
    leaving = files.where(F.col("path").startswith(prefix)).join(seen.select("path"), "path", "left_anti")
    return files.join(leaving.select("path"), "path", "left_anti"), leaving


def drop_orphans(table: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (of passages, vectors, postings) whose content some file still has."""
    return table.join(files.select("hash").distinct(), "hash", "left_semi")


def known_paths(files: DataFrame, problems: DataFrame, prefix: str) -> DataFrame:
    return files.select("path").where(F.col("path").startswith(prefix)).union(problems.select("path").where(F.col("path").startswith(prefix))).distinct()


def under(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """The paths below one of the folders: each path is joined on the folders above it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    spread = paths.select("path", F.explode(above).alias("_f"))
    return spread.join(folders.select(F.col("path").alias("_f")).distinct(), "_f", "left_semi").select("path").distinct()


def index_faults(passages: DataFrame, held: DataFrame, sizes: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """One row: postings that should be there, and how many are missing, wrong, or of no passage; lengths that are wrong
    or missing; passages of no file."""
    from . import postings

    fresh = postings.postings(passages, key).select(*key, "term", "surface", F.col("tf").alias("_tf"), F.col("positions").alias("_p"), F.lit(1).alias("_f"))
    both = fresh.join(held.select(*key, "term", "surface", "tf", "positions", F.lit(1).alias("_h")), [*key, "term", "surface"], "full")
    wrong = F.col("_f").isNotNull() & F.col("_h").isNotNull() & ((F.col("tf") != F.col("_tf")) | (F.col("positions") != F.col("_p")))
    counts = both.agg(F.count("_f").alias("postings"), F.count_if(F.col("_h").isNull()).alias("missing"), F.count_if(F.col("_f").isNull()).alias("extra"), F.count_if(wrong).alias("wrong"))
    lengths = postings.lengths(passages, key).withColumnRenamed("dl", "_dl").join(sizes, key, "full")
    lengths = lengths.agg(F.count_if(F.coalesce(F.col("dl") != F.col("_dl"), F.lit(True))).alias("lengths"))
    orphans = passages.join(files.select("hash").distinct(), "hash", "left_anti").agg(F.count("*").alias("orphans"))
    return counts.join(F.broadcast(lengths)).join(F.broadcast(orphans))  # one row each


def record_problems(problems: DataFrame, new: DataFrame) -> DataFrame:
    """``problems`` with ``new`` (path, size, modified_secs, reason): one more attempt where size and date are the
    same, else the first."""
    old = problems.select("path", "size", "modified_secs", F.col("attempts").alias("_a"))
    counted = new.join(old, ["path", "size", "modified_secs"], "left").select("path", "size", "modified_secs", "reason", (F.coalesce("_a", F.lit(0)) + 1).cast("int").alias("attempts"))
    return problems.join(new.select("path"), "path", "left_anti").select(*counted.columns).unionByName(counted)


def forget_failures(problems: DataFrame) -> DataFrame:
    return problems.where(~is_failure(F.col("reason")))


def reasons(spark) -> DataFrame:
    return spark.createDataFrame([(c, f, t) for c, f, t in REASONS], "code string, is_failure boolean, text string")


def report(plan: DataFrame) -> DataFrame:
    """One row of counts by action."""
    return plan.agg(*[F.count_if(F.col("action") == a).alias(a.replace("-", "_")) for a in ("unsupported", "unchanged", "cloud_known", "cloud_new", "known_problem", "read") for a in [a.replace("_", "-")]])


def verdict(answer: Column, exit_ok: Column, memory_limit: Column, cpu_limit: Column) -> Column:
    """Reason for a reader's end, or ok. answer: pages, timeout, truncated or invalid."""
    return (
        F.when(memory_limit, "memory-limit")
        .when(cpu_limit, "timed-out")
        .when(answer == "timeout", "timed-out")
        .when((answer == "pages") & exit_ok, "ok")
        .when(answer == "pages", "crashed")
        .when((answer == "truncated") & ~exit_ok, "crashed")
        .otherwise("invalid-output")
    )


def bulk(leaving: Column, all_passages: Column) -> Column:
    """Whether so many passages leave that the tables are rewritten."""
    return leaving > all_passages * BULK_SHARE
