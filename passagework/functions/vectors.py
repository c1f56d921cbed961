"""Vectors as columns of array<double>."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trimmed, words


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # the length is a field, so that it is computed once and not for each element
    return F.transform(F.array(F.struct(v.alias("v"), length.alias("n"))), lambda s: F.when(s["n"] == 0, s["v"]).otherwise(F.transform(s["v"], lambda x: x / s["n"])))[0]


def mean_pool(rows: Column) -> Column:
    """The average of an array of equally long vectors."""
    return F.transform(F.element_at(rows, 1), lambda _, i: F.aggregate(rows, F.lit(0.0), lambda s, r: s + F.get(r, i)) / F.size(rows))


def mean_of_groups(rows: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(key, n, vector) with the average of each group's vectors, of which each partition sends sums by axis only."""
    means = F.array(*[F.avg(F.element_at(doubles(F.col(vector)), i + 1)) for i in range(dims)])
    return rows.groupBy(key).agg(F.count("*").alias("n"), means.alias(vector))


def with_word_vector(rows: DataFrame, text: Column, name: str = "embedding", dims: int = 64) -> DataFrame:
    """``rows`` with a stand-in for a model's vector: counts of the words' digests by bucket, of unit length; without
    words the first axis. The buckets are a column of their own, so that each word is digested once."""
    keep = rows.columns
    found = F.filter(F.transform(words(text), lambda w: trimmed(F.lower(w))), lambda w: w != "")
    buckets = F.sort_array(F.transform(found, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dims))
    given = rows.withColumn("_b", buckets)
    axes = F.sequence(F.lit(0), F.lit(dims - 1))
    counts = F.transform(axes, lambda b: (F.size("_b") - F.size(F.array_remove("_b", b))).cast("double"))
    first = F.transform(axes, lambda b: F.when(b == 0, 1.0).otherwise(0.0))
    given = given.select(*keep, F.when(F.size("_b") == 0, first).otherwise(counts).alias("_v"))
    return given.select(*keep, unit(F.col("_v")).alias(name))


#: Words whose buckets a worker keeps.
KNOWN_WORDS = 1 << 20


def bucket(word: str, dims: int) -> int:
    """Bucket of a word; ``dims`` for one without a letter or digit."""
    low = word.lower()
    held = [i for i, c in enumerate(low) if unicodedata.category(c)[0] in "LN"]
    return bucket_of(low[held[0] : held[-1] + 1].encode(), dims) if held else dims


def bucket_of(word: bytes, dims: int) -> int:
    """Bucket of a word in small letters that begins and ends with a letter or digit."""
    return int.from_bytes(hashlib.md5(word).digest()[:4]) % dims


class _Buckets(dict):
    """Buckets of words."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, word: str) -> int:
        found = bucket(word, self.dims)
        if len(self) < KNOWN_WORDS:
            self[word] = found
        return found


def _unit_rows(counts: np.ndarray) -> pa.ListArray:
    """Rows of counts divided by their lengths; the first axis for those without any."""
    counts[~counts.any(axis=1), 0] = 1.0
    flat = (counts / np.sqrt((counts * counts).sum(axis=1))[:, None]).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, counts.shape[1]), pa.int32()), pa.array(flat))


def rows_of_counts(column: pa.Array, dims: int) -> pa.ListArray:
    """Vectors of counts, ``dims`` numbers of four bytes each."""
    return _unit_rows(np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, dims).astype(float))


def vectors_of_counts(units: DataFrame, key: list[str], dims: int = 64) -> DataFrame:
    """key and embedding of units (key, counts), whose counts are ``dims`` numbers of four bytes: the vectors of
    ``with_word_vector`` for the texts that were counted."""
    kinds = {f.name: f.dataType.simpleString() for f in units.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], rows_of_counts(batch.column(len(key)), dims)], [*key, "embedding"])

    return units.select(*key, "counts").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in key) + ", embedding array<double>")


def word_vectors(passages: DataFrame, key: list[str], dims: int = 64) -> DataFrame:
    """key and embedding of passages (key, text), of which words stand one space apart: the vectors of
    ``with_word_vector``, for whole tables. A worker digests a word once and counts a batch's words at once."""
    kinds = {f.name: f.dataType.simpleString() for f in passages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(dims)
        for batch in batches:
            counts = np.zeros((batch.num_rows, dims + 1))
            for i, text in enumerate(batch.column(len(key)).to_pylist()):
                found = np.fromiter(map(buckets.__getitem__, text.split(" ") if text else ()), np.int64)
                counts[i] = np.bincount(found, minlength=dims + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], _unit_rows(np.ascontiguousarray(counts[:, :dims]))], [*key, "embedding"])

    return passages.select(*key, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in key) + ", embedding array<double>")
