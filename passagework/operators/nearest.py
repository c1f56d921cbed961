"""Exact nearest vectors of many queries at once, and vector upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Query vectors in one pass; more are searched a block at a time.
QUERY_BLOCK = 4096


def _best(q: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each query; ties at the end stay for the final order."""
    order = np.lexsort((d, q))
    qs, ds = q[order], d[order]
    first = np.flatnonzero(np.append(True, qs[1:] != qs[:-1]))
    size = np.diff(np.append(first, len(qs)))
    bar = ds[first + np.minimum(size, k) - 1]
    return order[ds <= np.repeat(bar, size)]


def knn(vectors: DataFrame, queries: DataFrame, key: list[str], k: int) -> DataFrame:
    """query_id, rank, key, distance and score (1 - d^2 / 2) of the k nearest of each query.

    ``queries`` (query_id, embedding) is a stated set, read a block at a time. Each task multiplies its vectors with a
    block of queries and keeps its own best k of each over all its batches, so what is shuffled is k rows for a query
    and task, and ties. Vectors with ``counts`` in place of embedding are those of ``vectors.vectors_of_counts``."""
    spark, counted = vectors.sparkSession, "counts" in vectors.columns
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = "query_id long, " + "".join(f"{c} {kinds[c]}, " for c in key) + "distance double"
    given = vectors.select(*key, "counts" if counted else V.doubles(F.col("embedding")).alias("embedding"))

    def blocks() -> Iterator[list[tuple]]:
        block: list[tuple] = []
        for row in queries.select("query_id", V.doubles(F.col("embedding"))).toLocalIterator():
            block.append((row[0], row[1]))
            if len(block) == QUERY_BLOCK:
                yield block
                block = []
        if block:
            yield block

    found = None
    for block in blocks():
        shared = spark.sparkContext.broadcast((np.array([q for q, _ in block], np.int64), np.array([v for _, v in block], float)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            held: pa.Table | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                column = batch.column(len(key))
                if counted:
                    column = V.rows_of_counts(column, asked.shape[1])
                flat = column.flatten().to_numpy(zero_copy_only=False)
                if len(flat) != len(column) * asked.shape[1] or set(np.diff(column.offsets.to_numpy())) != {asked.shape[1]}:
                    raise ValueError(f"a vector must have {asked.shape[1]} numbers, as the queries have")
                x = flat.reshape(len(column), -1)
                d = np.round(np.sqrt(np.maximum((x * x).sum(1)[:, None] + (asked * asked).sum(1)[None] - 2 * x @ asked.T, 0)), 6)
                n = min(k, len(x))
                row, col = np.nonzero(d <= np.partition(d, n - 1, axis=0)[n - 1])
                some = pa.table([pa.array(col), *[batch.column(c).take(pa.array(row)) for c in range(len(key))], pa.array(d[row, col])], names=["_q", *key, "distance"])
                held = some if held is None else pa.concat_tables([held, some]).combine_chunks()
                held = held.take(pa.array(_best(held["_q"].to_numpy(), held["distance"].to_numpy(), k)))
            if held is not None:
                columns = [pa.array(ids[held["_q"].to_numpy()]), *[held[c].combine_chunks() for c in (*key, "distance")]]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["query_id", *key, "distance"])

        part = given.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema.replace("query_id long, ", "query_id long, rank long, ") + ", score double")
    order = W.partitionBy("query_id").orderBy("distance", *key)
    best = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return best.select("query_id", "rank", *key, "distance", F.round(1 - F.col("distance") * F.col("distance") / 2, 6).alias("score"))


def missing(passages: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    return passages.join(vectors.select(*key), key, "left_anti")


def put(vectors: DataFrame, new: DataFrame, passages: DataFrame, key: list[str], dims: int) -> DataFrame:
    """``vectors`` with ``new`` in place of equals; those of passages that are gone are left out, and a wrong size
    is an error."""
    right = F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector must have {dims} numbers")))
    fresh = new.withColumn("embedding", right).join(passages.select(*key), key, "left_semi")
    return vectors.join(fresh.select(*key), key, "left_anti").select(*key, "embedding").unionByName(fresh.select(*key, "embedding"))
