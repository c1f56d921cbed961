"""Few items in many texts: which text holds which item, and at which line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an item that are looked for at every place of a text; items with fewer are searched for one by one.
WIDTH = 8
_TABLE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slot(x: np.ndarray) -> np.ndarray:
    return (x * _MIX) >> np.uint64(44)


def holding(texts: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """hash, lang, query_id, item and line (from 1) of the first place of each item (query_id, item) in each text (hash,
    lang, text). ``WIDTH`` bytes from the middle of each item are compared with all places of a text at once; where they
    stand, the text is searched for the whole item."""
    shared = texts.sparkSession.sparkContext.broadcast([(i, item, item.encode()) for i, item in items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        short = [n for n, (_, _, raw) in enumerate(asked) if len(raw) < WIDTH]
        keys: dict[int, list[int]] = {}
        for n, (_, _, raw) in enumerate(asked):
            if len(raw) >= WIDTH:
                mid = (len(raw) - WIDTH) // 2
                keys.setdefault(int.from_bytes(raw[mid : mid + WIDTH], "little"), []).append(n)
        known = np.array(sorted(keys), np.uint64)
        table = np.zeros(_TABLE, bool)
        table[_slot(known)] = True
        for batch in batches:
            rows = []
            for at, text in enumerate(batch.column(2)):
                raw = text.as_py()
                if raw is None:
                    continue
                found = set(short)
                for shift in range(min(WIDTH, max(len(raw) - WIDTH + 1, 0)) if len(known) else 0):
                    here = np.frombuffer(raw, "<u8", (len(raw) - shift) // WIDTH, shift)
                    for key in set(here[table[_slot(here)]].tolist()):
                        found.update(keys.get(key, ()))
                for n in sorted(found):
                    place = raw.find(asked[n][2])
                    if place >= 0:
                        rows.append((at, n, raw.count(b"\n", 0, place) + 1))
            at, n, line = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
            at = pa.array(at, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array([asked[i][0] for i in n], pa.int64()), pa.array([asked[i][1] for i in n], pa.string()), pa.array(line, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "lang", "query_id", "item", "line"])

    return texts.selectExpr("hash", "lang", "cast(text as binary) as text").mapInArrow(run, "hash string, lang string, query_id long, item string, line long")
