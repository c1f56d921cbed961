"""Odd rows that every operator must take, and columns that bear the operators' own names."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_r = random.Random(5)
WORDS = ["".join(_r.choice("abcdefghijklmnop") for _ in range(_r.randint(2, 8))) for _ in range(300)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("\n" if r.random() < 0.08 else "") for _ in range(n))


BASE = prose(1, 160)
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
TEXTS = [
    (3, BASE),
    (4, None),
    (5, ""),
    (6, " \n\t\x0b "),
    (7, BASE),
    (8, BASE.replace(WORDS[3], "changed")),
    (8, BASE.replace(WORDS[3], "changed")),
    (9, LONG),
    (10, LONG + " tail"),
    (None, BASE),
    (None, None),
    (11, "one"),
    (12, "one"),
    (13, prose(2, 120) + "\n" + BASE[:400]),
    (14, prose(3, 90) + " éÉß日本語 😀 \x00 'll 12345"),
    (15, "x" * 5_000),
]


def odd(spark, clash: bool = True):
    rows = [(i, t, "en" if (i or 0) % 2 else None, None if i == 9 else "s0", len(t) if t is not None else None) for i, t in TEXTS]
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for c in ("n", "x", "h", "d", "tag", "kept", "slot", "shard", "n_words", "n_tokens", "rep", "size", "first", "host", "path", "_d"):
            df = df.withColumn(c, F.lit("extra"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
