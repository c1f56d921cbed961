"""Quality rules of a document and of its host.

A document's rules are counted within its row. Failures are summed by host; each host's rate is shrunk towards the
corpus rate with a beta prior that is fitted to all hosts by moments, and the verdict on the host goes back to its
documents. A host is rejected when its shrunk rate is over ``max_host_rate``, so a host with few documents is
judged mostly by the corpus.

Nulls: a null text has no words; documents without a source share the host ''. Repeated rows each count. Extra
columns are kept where whole documents are returned. An empty table gives no rows. All is DataFrame functions. A text is
counted within its row, a very long one with some 100 bytes for each word in one task. Hosts are sources as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
#: Texts of more words have their windows told apart by 128 bits, others by 64 less those that a place takes (50 here).
LONG_TEXT = 1 << 14
#: Host verdicts are broadcast up to so many rejected hosts (names of some 50 bytes), else joined by a shuffle.
BROADCAST_HOSTS = 100_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(keys: Column, bits: Column) -> Column:
    """Words covered by windows of three that occur twice; keys: sorted (window's hash << bits) | window's place."""
    high = lambda x: F.call_function("shiftright", x, bits)
    twice = F.filter(keys, lambda x, j: F.coalesce(high(F.get(keys, j - 1)) == high(x), F.lit(False)) | F.coalesce(high(F.get(keys, j + 1)) == high(x), F.lit(False)))
    return F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)))


def _long_repeats(words: Column, n: Column) -> Column:
    """The same for windows of long texts, by two whole hashes."""
    three = lambda i: [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]
    keys = F.sort_array(F.transform(F.sequence(F.lit(0), (n - 3).cast("int")), lambda i: F.struct(F.xxhash64(*three(i)).alias("a"), F.xxhash64(F.lit(1), *three(i)).alias("b"), i.cast("long").alias("at"))))
    # the keys are a field, so that they are sorted once
    held = F.transform(F.array(keys), lambda k: F.filter(k, lambda x, j: _same(F.get(k, j - 1), x) | _same(F.get(k, j + 1), x)))[0]
    return F.sort_array(F.transform(held, lambda x: x["at"]))


def _same(x: Column, y: Column) -> Column:
    return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]), F.lit(False))


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of COUNTS and base_failed; same names in ``docs`` are replaced."""
    keep = [c for c in docs.columns if c not in (*COUNTS, "base_failed")]
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(*[F.col(f"`{c}`") for c in keep], F.array_remove(F.split(text, SPACES, -1), "").alias("_words"), F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    # a window's place takes the low bits, as many as the number of words has
    two = one.select(*keep, "n_symbols", "_words", F.size("_words").cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.char_length(F.bin(F.size("_words").cast("long"))).alias("_bits"))
    words = F.col("_words")
    windows = F.when(
        (F.col("n_words") >= 3) & (F.col("n_words") <= LONG_TEXT),
        F.sort_array(F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.call_function("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), F.col("_bits")).bitwiseOR(i.cast("long")))),
    ).otherwise(F.array().cast("array<bigint>"))
    three = two.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "_bits", windows.alias("_keys"), F.when(F.col("n_words") > LONG_TEXT, _long_repeats(words, F.col("n_words"))).alias("_long"))
    four = three.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce("_long", _repeat_words(F.col("_keys"), F.col("_bits"))).alias("_at"))
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, j + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)
    five = four.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return five.withColumn("base_failed", failed)


def host_verdicts(counted: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """_host, n, failures, rate (shrunk) and host_failed of every host."""
    hosts = counted.groupBy(F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("_host")).agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failures"))
    raw = F.col("failures") / F.col("n")
    mean = hosts.agg((F.sum("failures") / F.sum("n")).alias("_mean"))
    spread = hosts.join(F.broadcast(mean)).agg(F.max("_mean").alias("_mean"), (F.sum(F.col("n") * (raw - F.col("_mean")) * (raw - F.col("_mean"))) / F.sum("n")).alias("_var"))  # one row each
    strength = F.when(F.col("_var") > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.col("_mean") * (1 - F.col("_mean")) / F.col("_var") - 1))).otherwise(F.lit(1e6))
    rate = (F.col("failures") + F.col("_mean") * strength) / (F.col("n") + strength)
    return hosts.join(F.broadcast(spread)).select("_host", "n", "failures", rate.alias("rate")).withColumn("host_failed", F.col("rate") > max_host_rate)


def with_verdicts(counted: DataFrame, scratch: Scratch, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``counted`` with host_failed and kept. ``counted`` should be a written table, as it is read twice."""
    bad = scratch.save(host_verdicts(counted, host, max_host_rate).where("host_failed").select("_host", "host_failed"), "hosts")
    small = bad.count() <= BROADCAST_HOSTS
    keyed = counted.drop("host_failed", "kept").withColumn("_host", F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")))
    joined = keyed.join(F.broadcast(bad) if small else bad, "_host", "left").drop("_host")
    return joined.withColumn("host_failed", F.coalesce("host_failed", F.lit(False))).withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def judge(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, the counts, base_failed, host_failed and kept of each row."""
    counted = scratch.save(with_counts(docs.select("doc_id", "source", "text")).drop("text"), "counts")
    return with_verdicts(counted, scratch).select("doc_id", *COUNTS, "base_failed", "kept", "host_failed", "source")


def keep_good(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with the columns of ``docs``."""
    counted = with_counts(docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(docs.columns)], F.col("text"), F.col("source")))
    counted = scratch.save(counted.drop("text", "_words"), "counted")
    return with_verdicts(counted, scratch).where("kept").select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(docs.columns)])
