"""Best units of many queries by BM25, in one pass over what the units hold of the queries' terms.

Units are rows (key, dl, hits: t, tf and n, as ``units.units`` gives). A task scores a batch of units for all queries at
once, by sums over (unit, query), and keeps its own best of each query; what is shuffled is that many rows for a query
and task."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BM25_B, BM25_K1, IDF_FLOOR

#: Sums of (unit, query) that a task holds at once.
SUMS = 1 << 21


@dataclass
class Totals:
    """Units, their average length, and by term the units that hold it and its occurrences."""

    n_units: int
    avgdl: float
    doc: np.ndarray
    cnt: np.ndarray


@dataclass
class Query:
    """Terms of a query as (t, phrase, spelt): whether it is a phrase and whether its spellings count (a token's do once)."""

    query_id: int
    terms: list[tuple[int, bool, bool]] = field(default_factory=list)
    n_phrases: int = 0
    needed: int = 0


def _hits(batch: pa.RecordBatch, dl: int, hits: int) -> tuple[np.ndarray, ...]:
    """Lengths of a batch's units, and unit, t, tf and n of its hits."""
    listed = batch.column(hits)
    offsets = listed.offsets.to_numpy()
    fields = listed.flatten().flatten()
    return batch.column(dl).to_numpy(), np.repeat(np.arange(len(listed)), np.diff(offsets)), *(f.to_numpy() for f in fields)


def totals(units: DataFrame, n_asked: int) -> Totals:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, length, doc, cnt = 0, 0, np.zeros(n_asked, np.int64), np.zeros(n_asked, np.int64)
        for batch in batches:
            dl, _, t, tf, _ = _hits(batch, 0, 1)
            n, length = n + len(dl), length + int(dl.sum())
            doc += np.bincount(t, minlength=n_asked)
            cnt += np.bincount(t, tf, minlength=n_asked).astype(np.int64)
        held = np.flatnonzero(doc)
        columns = [np.append(-1, held), np.append(n, doc[held]), np.append(length, cnt[held])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["t", "doc", "cnt"])

    doc, cnt, n, length = np.zeros(n_asked, np.int64), np.zeros(n_asked, np.int64), 0, 0
    for row in units.select("dl", "hits").mapInArrow(run, "t long, doc long, cnt long").groupBy("t").agg(F.sum("doc"), F.sum("cnt")).collect():
        if row[0] < 0:
            n, length = row[1], row[2]
        else:
            doc[row[0]], cnt[row[0]] = row[1], row[2]
    return Totals(n, length / n if n else 0.0, doc, cnt)


def idf(n_units: int, holding: int) -> float:
    raw = math.log((n_units - holding + 0.5) / (holding + 0.5))
    return raw if raw > 0 else IDF_FLOOR


def _cut(rows: pa.Table, key: list[str], k: int) -> pa.Table:
    """The best k of each query; ties by key."""
    # scores first, so that keys are compared among equals only at the end of each query's list
    q, score = rows["_q"].to_numpy(), rows["score"].to_numpy()
    order = np.lexsort((-score, q))
    first = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1]))
    size = np.diff(np.append(first, len(q)))
    bar = np.repeat(score[order][first + np.minimum(size, k) - 1], size)
    ahead = score[order] >= bar
    tied = ahead & (score[order] == bar)
    if ahead.sum() > np.minimum(size, k).sum():
        some = np.sort(order[tied])
        by_key = some[pc.sort_indices(rows.select(key).take(pa.array(some)), [(c, "ascending") for c in key]).to_numpy()]
        place = np.zeros(len(q), np.int64)
        place[by_key] = np.arange(len(by_key))
        order = np.lexsort((place, -score, q))
        nth = np.arange(len(q)) - np.repeat(first, size)
        ahead = nth < k
    return rows.take(pa.array(order[ahead]))


def best(units: DataFrame, key: list[str], queries: list[Query], of: Totals, k: int, whole: bool = True) -> DataFrame:
    """query_id, key, score, matched (spellings of the query's terms) and enough (a phrase, or as many spellings as are
    needed) of units that may be among the best k of a query, each task's own best k; with ``whole`` of those that
    hold all its phrases."""
    spark = units.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in units.schema.fields}
    n_asked = len(of.doc)
    flat = sorted((t, i, phrase, spelt) for i, q in enumerate(queries) for t, phrase, spelt in q.terms)
    term, asked, phrase, spelt = (np.array(c, np.int64) for c in zip(*flat, strict=True)) if flat else (np.zeros(0, np.int64),) * 4
    weight = np.array([idf(of.n_units, int(of.doc[t])) for t in term.tolist()], float)
    firsts = np.searchsorted(term, np.arange(n_asked + 1))
    ids = np.array([q.query_id for q in queries], np.int64)
    n_phrases, needed = np.array([q.n_phrases for q in queries], np.int64), np.array([q.needed for q in queries], np.int64)
    shared = spark.sparkContext.broadcast((firsts, asked, phrase, spelt, weight, ids, n_phrases, needed, of.avgdl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, asked, phrase, spelt, weight, ids, n_phrases, needed, avgdl = shared.value
        many, n_queries = np.diff(firsts), len(ids)
        at_once = max(1, SUMS // max(n_queries, 1))
        bars, held, waiting = np.full(n_queries, -1.0), None, 0
        for whole_batch in batches:
            for begin in range(0, whole_batch.num_rows, at_once):
                batch = whole_batch.slice(begin, at_once)
                dl, unit, t, tf, n = _hits(batch, len(key), len(key) + 1)
                use = np.flatnonzero(many[t])
                unit, t, tf, n = unit[use], t[use], tf[use], n[use]
                row = np.repeat(np.arange(len(t)), many[t])
                place = np.arange(len(row)) + np.repeat(firsts[t] - (np.cumsum(many[t]) - many[t]), many[t])
                below = tf + BM25_K1 * (1 - BM25_B + BM25_B * dl[unit] / avgdl) if len(t) else tf
                cell, bins = asked[place] * len(dl) + unit[row], n_queries * len(dl)
                score = np.bincount(cell, weight[place] * tf[row] * (BM25_K1 + 1) / below[row], minlength=bins)
                rounded = np.round(score, 6)
                take = (score > 0) & (rounded >= np.repeat(bars, len(dl)))
                if n_phrases.any() and whole:
                    take &= np.bincount(cell, phrase[place], minlength=bins) == np.repeat(n_phrases, len(dl))
                chosen = np.flatnonzero(take)
                if not len(chosen):
                    continue
                q, u = chosen // len(dl), chosen % len(dl)
                # spellings are counted for the chosen alone
                nth = np.searchsorted(chosen, cell)
                own = np.flatnonzero(chosen[np.minimum(nth, len(chosen) - 1)] == cell)
                matched = np.bincount(nth[own], n[row[own]] * spelt[place[own]], minlength=len(chosen)).astype(np.int64)
                some = pa.table([pa.array(q), *[batch.column(c).take(pa.array(u)) for c in range(len(key))], pa.array(rounded[chosen]), pa.array(matched)], names=["_q", *key, "score", "matched"])
                held = some if held is None else pa.concat_tables([held, some])
                waiting += len(chosen)
                if waiting >= max(2 * n_queries * k, 50_000):
                    held, waiting = _cut(held.combine_chunks(), key, k), 0
                    q, score = held["_q"].to_numpy(), held["score"].to_numpy()
                    size = np.bincount(q, minlength=n_queries)
                    last = np.cumsum(size) - 1
                    bars = np.where(size >= k, score[np.maximum(last, 0)], -1.0)
        if held is not None:
            held = _cut(held.combine_chunks(), key, k).combine_chunks()
            q, matched = held["_q"].to_numpy(), held["matched"].to_numpy()
            out = pa.table([pa.array(ids[q]), *[held[c] for c in (*key, "score", "matched")], pa.array((n_phrases[q] > 0) | (matched >= needed[q]))], names=["query_id", *key, "score", "matched", "enough"])
            yield from out.to_batches()

    schema = "query_id long, " + "".join(f"{c} {kinds[c]}, " for c in key) + "score double, matched long, enough boolean"
    return units.select(*key, "dl", "hits").mapInArrow(run, schema)


def holding(units: DataFrame, key: list[str], queries: list[Query]) -> DataFrame:
    """query_id, no (its place among the query's phrases) and key of each phrase in each unit that holds it."""
    kinds = {f.name: f.dataType.simpleString() for f in units.schema.fields}
    rows = sorted((t, q.query_id, no) for q in queries for no, (t, _, _) in enumerate(x for x in q.terms if x[1]))
    shared = units.sparkSession.sparkContext.broadcast(tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, ids, nos = shared.value
        for batch in batches:
            _, unit, t, _, _ = _hits(batch, len(key), len(key) + 1)
            low, high = np.searchsorted(term, t), np.searchsorted(term, t, side="right")
            use = np.flatnonzero(high > low)
            unit, low, many = unit[use], low[use], (high - low)[use]
            place = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
            at = pa.array(np.repeat(unit, many))
            yield pa.RecordBatch.from_arrays([pa.array(ids[place]), pa.array(nos[place]), *[batch.column(c).take(at) for c in range(len(key))]], ["query_id", "no", *key])

    return units.select(*key, "dl", "hits").mapInArrow(run, "query_id long, no long, " + ", ".join(f"{c} {kinds[c]}" for c in key))
