"""Substring dedup by the common-prefix interval tree of a sparse suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id; strings
are judged on the input, and overlaps count.

Every string of LENGTH bytes is assigned to an anchor, the place of its least K-byte hash (the leftmost of equals).
Equal strings have the same anchor at the same distance, so only the suffixes that start at anchors are sorted: one
in some sixteen. What surrounds an anchor, as far as the strings assigned to it reach, is its context.

1. Anchors are counted by hash. Those that a single document has are dropped; they repeat nothing.
2. The contexts of the others meet by hash. Equal contexts are one leaf with all its occurrences, and a block of the
   input sends one record for a leaf: the block's other documents are covered by it there and then. So a passage
   that a third of all documents share sends one record for a block.
3. The leaves of a hash, sorted by what follows the anchor, are a suffix array. A stack scan of its common prefixes
   yields the intervals of suffixes with a common prefix, and within an interval the leaves are split by what
   precedes the anchor: the same scan over the reversed left sides, which tests whether all extend to the left alike.
   Each node with LENGTH bytes or more is a maximal repeat with all its occurrences; those in documents beyond its
   smallest doc_id are covered.
4. A hash with more than ``HOT`` documents would make a large group; each of its strings becomes a record of its own
   with the whole string as the key, where equal records combine on the map side. That is exact as well.

Whole texts that equal one with a smaller doc_id are covered without a search.

Nulls: a null text is empty. A row without a doc_id neither covers nor is covered. Rows that share a doc_id don't
cover each other and are judged apart. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import _BYTE, _STEP, mix, powers, slices

LENGTH, K = 50, 20
SPAN = LENGTH - K  # farthest that an anchor is from the start of its strings
WIDTH = LENGTH + SPAN  # the longest context
HOT = 200_000
BLOCK = 1_500_000
BROADCAST_COPIES = 2_000_000
_U = np.uint64
_WEIGHTS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**64, WIDTH + 2, dtype=np.uint64) | _U(1)
_INVERSE = _U(pow(int(_STEP), -1, 2**64))
_inverse = np.ones(1, np.uint64)


def _inverses(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        more = np.full(n + 4096, _INVERSE, np.uint64)
        more[0] = 1
        _inverse = np.multiply.accumulate(more)
    return _inverse[:n]


def anchors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place, first string, last string) of the anchors of a slice, places within the slice."""
    none = np.zeros(0, np.int64)
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.uint64), none, none, none, none
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(n), out=total[1:])
    least = mix((total[K:] - total[:-K]) * _inverses(n + 1 - K))
    hashed = least
    at = np.arange(len(least), dtype=np.int32)
    width = 1
    while width < SPAN + 1:
        step = min(width, SPAN + 1 - width)
        later = least[step:] < least[:-step]
        at = np.where(later, at[step:], at[:-step])
        least = np.where(later, least[step:], least[:-step])
        width += step
    size = np.diff(off)
    starts = np.maximum(size - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(size)), starts)
    s = np.arange(len(text)) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(off[:-1], starts)
    if not len(s):
        return np.zeros(0, np.uint64), none, none, none, none
    a = at[s]
    begin = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (text[1:] != text[:-1])))
    end = np.append(begin[1:], len(s)) - 1
    return hashed[a[begin]], text[begin], a[begin].astype(np.int64), s[begin], s[end]


def _pack(*columns: np.ndarray) -> bytes:
    return len(columns[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _deal(bucket: np.ndarray, buckets: int, kind: int, columns: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cut = [*_runs(bucket).tolist(), len(bucket)]
    return [(int(bucket[i]), kind, _pack(*[c[i:j] for c in columns])) for i, j in zip(cut[:-1], cut[1:], strict=True)]


BLOBS = "bucket int, kind int, blob binary"


def _blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "blob"])


def _send_anchors(buckets: int):
    """Kind 0: (hash, doc, documents of the block with it), one for a hash and block. Kind 1: (doc, hash) that the block
    has in several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        docs: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            first = _runs(h, d)
            h, d = h[first], d[first]
            begin = _runs(h)
            size = np.diff(np.append(begin, len(h)))
            several = np.repeat(size > 1, size)
            rows = _deal((h[begin] % _U(buckets)).astype(np.int32), buckets, 0, [h[begin], d[begin], size.astype(np.uint32)])
            if several.any():
                # a bucket for a hash's other half: a common hash's documents are not sent to one place
                rows += _deal((mix(d[several].view(np.uint64)) % _U(buckets)).astype(np.int32), buckets, 1, [d[several], h[several]])
            return _blob_batch(rows)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, raw, off in slices(batch):
                h, text, _, _, _ = anchors(raw, off)
                hashes.append(h)
                docs.append(ids[i:j][text])
                if sum(map(len, hashes)) >= BLOCK:
                    yield out()
                    hashes, docs = [], []
        if sum(map(len, hashes)):
            yield out()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The blobs of kinds 0 and 1 of one bucket after another."""
    at, parts = None, ([], [])
    for batch in batches:
        for b, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if b != at and at is not None:
                yield parts
                parts = ([], [])
            at = b
            parts[kind].append(blob.as_py())
    if at is not None:
        yield parts


def _share_anchors(hot: int):
    """(doc, hash) of hashes that several documents have; (null, hash) of those with more than ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for alone, shared in _by_bucket(batches):
            docs, hashes = [], []
            for blob in shared:
                d, h = _unpack(blob, "<i8", "<u8")
                docs.append(pa.array(d))
                hashes.append(h.view(np.int64))
            if alone:
                parts = [_unpack(blob, "<u8", "<i8", "<u4") for blob in alone]
                h, d, n = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.argsort(h, kind="stable")
                h, d, n = h[order], d[order], n[order]
                begin = _runs(h)
                size = np.diff(np.append(begin, len(h)))
                several = np.repeat(size > 1, size)
                docs.append(pa.array(d[several]))
                hashes.append(h[several].view(np.int64))
                many = h[begin][np.add.reduceat(n.astype(np.int64), begin) > hot]
                docs.append(pa.nulls(len(many), pa.int64()))
                hashes.append(many.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(docs), pa.array(np.concatenate(hashes), pa.int64())], ["doc", "h"])

    return run


def _context_hash(left: np.ndarray, size: np.ndarray, context: np.ndarray) -> np.ndarray:
    out = left.astype(np.uint64) * _WEIGHTS[WIDTH] + size.astype(np.uint64) * _WEIGHTS[WIDTH + 1]
    for c in range(WIDTH):
        out += context[:, c] * _WEIGHTS[c]
    return mix(out)


def _contexts(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes from ``start``, WIDTH to a row; 0xFF, which no UTF-8 has, stands behind a context's end."""
    place = np.arange(WIDTH)
    out = raw[np.minimum(start[:, None] + place, len(raw) - 1)]
    out[place >= size[:, None]] = 255
    return out


def _leaves(h: np.ndarray, left: np.ndarray, size: np.ndarray, context: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of leaves): rows sorted by hash, context and doc; equal contexts of a hash are a leaf."""
    mark = _context_hash(left, size, context)
    order = np.lexsort((doc, mark, h))
    h, mark, left, size, context = h[order], mark[order], left[order], size[order], context[order]
    new = np.zeros(len(h), bool)
    new[:1] = True
    new[1:] = (h[1:] != h[:-1]) | (mark[1:] != mark[:-1]) | (left[1:] != left[:-1]) | (size[1:] != size[:-1]) | (context[1:] != context[:-1]).any(axis=1)
    return order, np.flatnonzero(new)


RECORD = ("<u8", "<i8", "<i8", "<i4", "u1", "u1", f"V{WIDTH}")


def _send_contexts(buckets: int, hot):
    """Kind 0: records (hash, doc, tag, start, left, size, context) of leaves, for the block's smallest doc_id.
    Kind 1: (doc, tag, start, end) that the block covers itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hot.value
        parts: list[tuple] = []

        def out() -> pa.RecordBatch:
            h, doc, tag, start, left, size, context = (np.concatenate(c) for c in zip(*parts, strict=True))
            order, begin = _leaves(h, left, size, context, doc)
            h, doc, tag, start, left, size, context = (c[order] for c in (h, doc, tag, start, left, size, context))
            count = np.diff(np.append(begin, len(h)))
            beyond = doc > np.repeat(doc[begin], count)
            keep = np.flatnonzero(~beyond)
            rows = _deal((h[keep] % _U(buckets)).astype(np.int32), buckets, 0, [h[keep], doc[keep], tag[keep], start[keep], left[keep], size[keep], np.ascontiguousarray(context[keep]).view(f"V{WIDTH}")[:, 0]])
            if beyond.any():
                d, t, s, e = _union(doc[beyond], tag[beyond], start[beyond], start[beyond] + size[beyond])
                rows += _deal((mix(d.view(np.uint64)) % _U(buckets)).astype(np.int32), buckets, 1, [d, t, s, e])
            return _blob_batch(rows)

        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            flags = batch.column(3)
            for i, j, raw, off in slices(batch):
                h, text, a, first, last = anchors(raw, off)
                wanted = [np.asarray(f.values.to_numpy()).view(np.uint64) ^ mix(np.array([x], np.uint64)) for x, f in enumerate(flags.slice(i, j - i)) if f.is_valid]
                wanted = np.sort(np.concatenate(wanted)) if wanted else np.zeros(0, np.uint64)
                keep = np.flatnonzero(_in(h ^ mix(text.astype(np.uint64)), wanted))
                if not len(keep):
                    continue
                h, text, a, first, last = (c[keep] for c in (h, text, a, first, last))
                many = _in(h, table)
                if many.any():
                    n = (last - first + 1)[many]
                    each = np.repeat(first[many], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    place = np.repeat(a[many], n)
                    whole = _context_hash(place - each, np.full(len(each), LENGTH), _contexts(raw, each, np.full(len(each), LENGTH)))
                    h, text, a, first, last = (np.concatenate([c[~many], new]) for c, new in ((h, whole), (text, np.repeat(text[many], n)), (a, place), (first, each), (last, each)))
                size = last - first + LENGTH
                parts.append((h, ids[i:j][text], tags[i:j][text], (first - off[text]).astype(np.int32), (a - first).astype(np.uint8), size.astype(np.uint8), _contexts(raw, first, size)))
                if sum(len(p[0]) for p in parts) >= BLOCK // 8:
                    yield out()
                    parts = []
        if parts:
            yield out()

    return run


def _in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _union(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of each document joined where they meet."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order].astype(np.int64), end[order].astype(np.int64)
    group = np.zeros(len(doc), np.int64)
    group[_runs(doc, tag)] = 1
    group = np.cumsum(group) << 40
    reach = np.maximum.accumulate(end + group)
    new = np.append(True, start[1:] + group[1:] > reach[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(doc)) - 1
    return doc[begin], tag[begin], start[begin].astype(np.int32), (reach[last] - group[last]).astype(np.int32)


def intervals(common: list[int], n: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of the common-prefix tree over n sorted rows, children first.
    common[i] is the common prefix of rows i and i + 1."""
    stack = [(0, 0)]
    for i in range(1, n + 1):
        depth = common[i - 1] if i < n else -1
        first = i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i - 1
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


def _common(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefix of each row and the next; rows padded beyond ``size``."""
    same = rows[1:] == rows[:-1]
    length = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return np.minimum(length, np.minimum(size[1:], size[:-1]))


def maximal_repeats(left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray, least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes to the left, bytes to the right, rows) of every repeat of ``least`` bytes or more around an anchor.

    ``right`` holds what starts at the anchor and ``left`` what precedes it, reversed. The rows of a repeat are all
    that have it, also where some of them have more; a repeat is given if its rows differ in what follows, and
    within that where they differ in what precedes.
    """
    order = np.lexsort(right.T[::-1])
    deep = _common(right[order], right_size[order]).tolist()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    for depth, i, j in intervals(deep, len(order)):
        if i == j or depth + int(left_size.max()) < least:
            continue
        rows = order[i : j + 1]
        side = left[rows]
        rows = rows[np.lexsort(side.T[::-1])]
        back = _common(left[rows], left_size[rows]).tolist()
        for more, p, q in intervals(back, len(rows)):
            if p < q and more + depth >= least:
                some = rows[p : q + 1]
                place = rank[some]
                if min(deep[place.min() : place.max()]) == depth:  # else all of them have more to the right
                    yield more, depth, some


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tag, range) that a smaller doc_id covers; a range is start * 2 ** 32 + end."""
    for alone, covered in _by_bucket(batches):
        found = [tuple(_unpack(blob, "<i8", "<i8", "<i4", "<i4")) for blob in covered]
        if alone:
            parts = [_unpack(blob, *RECORD) for blob in alone]
            h, doc, tag, start, left, size, context = (np.concatenate(c) for c in zip(*parts, strict=True))
            context = context.view(np.uint8).reshape(-1, WIDTH)
            order, begin = _leaves(h, left, size, context, doc)
            h, doc, tag, start, left, size, context = (c[order] for c in (h, doc, tag, start, left, size, context))
            count = np.diff(np.append(begin, len(h)))
            beyond = doc > np.repeat(doc[begin], count)
            found.append((doc[beyond], tag[beyond], start[beyond], start[beyond] + size[beyond].astype(np.int32)))
            found += _across(h, doc, tag, start, left, size, context, begin, beyond)
        if found:
            d, t, s, e = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(d):
                d, t, s, e = _union(d, t, s, e)
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array((s.astype(np.int64) << 32) | e)], ["doc", "tag", "range"])


def _across(h, doc, tag, start, left, size, context, begin, beyond) -> list[tuple]:
    """Ranges that one leaf's documents owe to another leaf of the hash. Only the occurrences in a leaf's smallest
    doc_id can owe more, as the leaf covers the others whole."""
    group = _runs(h[begin])
    leaves = np.diff(np.append(group, len(begin)))
    busy = np.flatnonzero(leaves > 1)
    if not len(busy):
        return []
    # sides of the leaves of these groups: left sides reversed from the anchor, right sides from it
    which = np.concatenate([np.arange(group[g], group[g] + leaves[g]) for g in busy])
    row = begin[which]
    n_left = left[row].astype(np.int64)
    n_right = size[row].astype(np.int64) - n_left
    place = np.arange(SPAN)
    back = np.take_along_axis(context[row], np.maximum(n_left[:, None] - 1 - place, 0), axis=1)
    back[place >= n_left[:, None]] = 255
    place = np.arange(LENGTH)
    ahead = np.take_along_axis(context[row], np.minimum(n_left[:, None] + place, WIDTH - 1), axis=1)
    ahead[place >= n_right[:, None]] = 255
    smallest = doc[row]
    edge = np.append(np.cumsum(leaves[busy]) - leaves[busy], len(which))
    owed: list[tuple[int, int, int]] = []
    # two leaves are one interval; all of these are done at once
    two = edge[:-1][leaves[busy] == 2]
    if len(two):
        ahead_same = np.minimum.reduce([_prefix(ahead[two], ahead[two + 1]), n_right[two], n_right[two + 1]])
        back_same = np.minimum.reduce([_prefix(back[two], back[two + 1]), n_left[two], n_left[two + 1]])
        ok = (ahead_same + back_same >= LENGTH) & (smallest[two] != smallest[two + 1])
        later = two + (smallest[two + 1] > smallest[two])
        owed += zip(later[ok].tolist(), back_same[ok].tolist(), ahead_same[ok].tolist(), strict=True)
    for x in np.flatnonzero(leaves[busy] > 2).tolist():
        i, j = edge[x], edge[x + 1]
        for more, depth, rows in maximal_repeats(back[i:j], n_left[i:j], ahead[i:j], n_right[i:j], LENGTH):
            own = smallest[i + rows]
            owed += [(i + r, more, depth) for r in rows[own > own.min()].tolist()]
    if not owed:
        return []
    leaf, more, depth = (np.array(c, np.int64) for c in zip(*owed, strict=True))
    first = begin[which[leaf]]
    end_of = np.append(begin[1:], len(h))[which[leaf]]
    n = end_of - first
    rows = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    more, depth = np.repeat(more, n), np.repeat(depth, n)
    own = ~beyond[rows]
    rows, more, depth = rows[own], more[own], depth[own]
    at = start[rows] + left[rows].astype(np.int64)
    return [(doc[rows], tag[rows], (at - more).astype(np.int32), (at + depth).astype(np.int32))]


def _prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = a == b
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column(1).cast(pa.binary()), batch.column(2)
            rows = []
            for i in range(batch.num_rows):
                body = memoryview(texts[i].as_buffer()) if texts[i].is_valid else memoryview(b"")
                digest, at, removed, spans, kept = hashlib.sha256(), 0, 0, 0, []
                if ranges[i].is_valid:
                    r = np.sort(ranges[i].values.to_numpy())
                    first, end = r >> 32, r & 0xFFFFFFFF
                    reach = np.maximum.accumulate(end)
                    new = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
                    ends = reach[np.append(new[1:], len(r)) - 1]
                    for s, e in zip(first[new].tolist(), ends.tolist(), strict=True):
                        kept.append(body[at:s])
                        removed, spans, at = removed + e - s, spans + 1, e
                kept.append(body[at:])
                for piece in kept:
                    digest.update(piece)
                rows.append((len(body), removed, spans, digest.hexdigest()) + ((b"".join(kept),) if keep_text else ()))
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    return run


def remove_repeats(docs: DataFrame, scratch: Scratch, hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row; with ``keep_text`` also the kept bytes."""
    spark = docs.sparkSession
    buckets = max(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    ids = scratch.save(given.select("doc_id", "tag", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "ids")
    first = ids.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = scratch.save(ids.where(f"n_bytes >= {LENGTH}").join(first, "sha").where("doc_id > first_id").select("doc_id", "tag", "n_bytes"), "copies")
    gone = copies.select("doc_id", "tag").distinct()
    small = gone.count() <= BROADCAST_COPIES
    originals = given.join(F.broadcast(gone) if small else gone, ["doc_id", "tag"], "left_anti").select("doc_id", "tag", "text")

    sent = originals.where("doc_id is not null").select("doc_id", "text").mapInArrow(_send_anchors(buckets), BLOBS)
    shared = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_share_anchors(hot), "doc long, h long")
    shared = scratch.save(shared, "shared")
    common = np.sort(np.array(shared.where("doc is null").select("h").toPandas()["h"], np.int64).view(np.uint64))
    wanted = shared.where("doc is not null").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("h").alias("h"))
    found = originals.join(wanted, "doc_id").select("doc_id", "tag", "text", "h").mapInArrow(_send_contexts(buckets, spark.sparkContext.broadcast(common)), BLOBS)
    ranges = scratch.save(found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_search, "doc long, tag long, range long"), "ranges")
    scratch.drop("shared")
    grouped = ranges.groupBy(F.col("doc").alias("doc_id"), "tag").agg(F.collect_list("range").alias("ranges"))
    cut = originals.join(grouped, ["doc_id", "tag"], "left").select("doc_id", "text", "ranges").mapInArrow(_cut(keep_text), RESULT + ", kept binary" * keep_text)
    empty = hashlib.sha256().hexdigest()
    whole = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"), *([F.lit(b"").alias("kept")] * keep_text))
    return cut.unionByName(whole)
