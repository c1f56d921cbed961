"""A synthetic corpus for measuring scale: Zipf words and unit vectors, from hashes of positions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY, WORDS, PER_FILE, DIMS = 20_000, 60, 25, 384


def word(number: Column) -> Column:
    """A made-up word for each number below 26 ** 4: k and its digits to the base of 26, the lowest first."""
    letter = lambda n: F.char((F.lit(97) + n % 26).cast("long"))
    digits = [F.when(number >= 26**i if i else F.lit(True), letter(F.floor(number / 26**i))).otherwise("") for i in range(4)]
    return F.concat(F.lit("k"), *digits)


def passages(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """file, ordinal and text of n passages. Word i comes about 1 / (i + 1) times as often as the first: the inverse of
    the harmonic sum's integral, rounded down."""
    rows = spark.range(n).select(F.floor(F.col("id") / PER_FILE).alias("file"), (F.col("id") % PER_FILE).alias("ordinal"), "id")
    u = lambda i: F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(1 << 30)) / float(1 << 30)
    number = lambda i: F.least(F.floor(F.exp(u(i) * float(np.log(VOCABULARY + 1)))) - 1, F.lit(VOCABULARY - 1))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(WORDS)), lambda i: word(number(i))), " ")
    return rows.select("file", "ordinal", text.alias("text"))


def unit_vectors(spark: SparkSession, n: int, dims: int = DIMS, seed: int = 7) -> DataFrame:
    raw = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(2001)) / 1000.0 - 1.0)
    from ..functions.vectors import unit

    return spark.range(n).select("id", raw.alias("v")).select("id", unit(F.col("v")).alias("embedding"))
