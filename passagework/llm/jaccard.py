"""Exact Jaccard join of shingle sets, by prefixes, with skipping by set relations.

Sets that are equal form a class with one representative (the smallest doc_id). Tokens are ordered with those that
many documents share last, then by hash; two sets that link share a token of their prefixes. The inverted lists
of the prefix tokens are sorted by the token's position in the set, and pairs that the length and position bounds rule
out are left.

Answers are derived, not recomputed, where sets are alike. In a list of more than ``SMALL_LIST`` sets, a set is
first held only against the list's leader, the set in which the token stands earliest. Verified links are joined to
components. Then a list is open only if its sets still lie in several components; sets outside its largest
component are held against the sets of the other components, and those within one component are never compared.
So a group of near copies costs as many comparisons as it has sets, and no group is emitted as pairs or collected.

Which tokens are common decides speed, not results. They are found in one pass: a token in a share of all sets has
that share in some block of the input, so blocks report the tokens that reach the share. The list has at most
2 ** 21 tokens (each stands for 2 ** -21 of all tokens), 16 MB, and is broadcast.

A candidate pair is held against parity sketches first, where each token flips one bit: sets that differ in few tokens
differ in few bits, so a pair with more is no link. What passes is verified on the whole sets.

A text is linked with others if 100 * intersection >= ``percent`` * union. Nulls and empty texts have empty sets,
linked with nothing. A row without a doc_id links nothing and has no component. Rows that share a doc_id are judged
apart, each by its own text. Ties need no rule: a component bears its smallest doc_id. Extra columns are ignored. An
empty table gives no rows. A text is held whole in a worker, with some 60 times its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .words import find_words, shingles, slices

WORDS, PERCENT = 4, 85
SMALL_LIST = 8
HOT_LEAST, HOT_BITS = 64, 21
BLOCK = 1 << 21
#: Bytes of whole sets sent on at a time.
SENT = 1 << 22
#: Representatives in candidate pairs are broadcast up to so many ids (8 bytes each), else joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Sets compared with one leader in one group; larger groups are split, the leader's set goes to each part.
GROUP = 512
ENTRY = np.dtype([("t", "<u8"), ("x", "<i8"), ("n", "<i4"), ("i", "<i4")])


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of linked sets of these sizes."""
    return -((-percent * (n + m)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -((-percent * n) // 100) + 1 if n else 0


def sets_of(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each row."""
    for i, j, raw, off in slices(batch):
        hashed, text, _ = shingles(find_words(raw, off), k)
        cut = np.searchsorted(text, np.arange(j - i + 1))
        for r in range(j - i):
            yield i + r, np.unique(hashed[cut[r] : cut[r + 1]])


def _count_common(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        total = 0

        def out() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(kept), return_counts=True)
            often = n >= max(2, total >> (HOT_BITS - 1))
            tokens, n = found[often].view(np.int64), n[often]
            return pa.RecordBatch.from_arrays([pa.array([None, *tokens.tolist()], pa.int64()), pa.array([total, *n.tolist()], pa.int64())], ["t", "n"])

        for batch in batches:
            for _, s in sets_of(batch, k):
                kept.append(s)
                total += len(s)
                if total >= BLOCK:
                    yield out()
                    kept, total = [], 0
        if kept:
            yield out()

    return run


def common_tokens(docs: DataFrame, scratch: Scratch, k: int, name: str) -> np.ndarray:
    """Sorted hashes of tokens that many sets share; at most 2 ** HOT_BITS of them."""
    found = scratch.save(docs.select("text").mapInArrow(_count_common(k), "t long, n long"), name)
    total = found.where("t is null").agg(F.sum("n")).first()[0] or 0
    hot = found.where("t is not null").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT_LEAST, total >> HOT_BITS)).select("t")
    out = np.sort(np.array(hot.toPandas()["t"], np.int64).view(np.uint64))
    scratch.drop(name)
    return out


def among(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(s), bool)
    return table[np.minimum(np.searchsorted(table, s), len(table) - 1)] == s


def sketch(s: np.ndarray) -> bytes:
    """Parities of the tokens by their low bits: a power of two of them, half to one times the tokens."""
    bits = 64
    while bits < len(s) // 2:
        bits *= 2
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Bits by which sketches differ, the larger folded to the smaller: at most the tokens that only one set has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _alike(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 4))
            bar = n + m - 2 * needed(n, m, percent)
            ok = [least_difference(a.as_py(), b.as_py()) <= d for a, b, d in zip(batch.column(3), batch.column(5), bar.tolist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def alike(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that the sketches allow."""
    own = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    return pairs.join(own("x"), "x").join(own("y"), "y").select("x", "y", "nx", "sx", "ny", "sy").mapInArrow(_alike(percent), "x long, y long").distinct()


def _signatures(k: int, percent: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            rows, n, prints, cold, prefixes, sketches = [], [], [], [], [], []
            for r, s in sets_of(batch, k):
                rows.append(r)
                n.append(len(s))
                sketches.append(sketch(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                p = prefix_length(len(s), percent)
                hot = among(s, table)
                first = s[~hot][:p]
                cold.append(len(first))
                prefixes.append(np.concatenate([first, s[hot][: p - len(first)]]).tobytes())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(n, pa.int32()), pa.array(prints, pa.binary()), pa.array(cold, pa.int32()), pa.array(prefixes, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "n", "fp", "cold", "prefix", "sketch"])

    return run


def _entries(batch: pa.RecordBatch, hot: bool) -> np.ndarray:
    """Inverted-list entries of the cold, or of the hot, prefix tokens of representatives."""
    x, n, cold = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("rep", "n", "cold"))
    prefix = batch.column(batch.schema.get_field_index("prefix"))
    parts = [np.frombuffer(p.as_buffer(), "<u8") for p in prefix]
    spans = [(c, len(p)) if hot else (0, c) for c, p in zip(cold.tolist(), parts, strict=True)]
    size = np.array([b - a for a, b in spans], np.int64)
    out = np.zeros(int(size.sum()), ENTRY)
    if len(out):
        out["t"] = np.concatenate([p[a:b] for p, (a, b) in zip(parts, spans, strict=True)])
        out["x"], out["n"] = np.repeat(x, size), np.repeat(n, size)
        out["i"] = np.concatenate([np.arange(a, b, dtype=np.int32) for a, b in spans])
    return out


def _blobs(buckets: int):
    """Cold entries, dealt to buckets by token: (bucket, bytes of entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            e = np.concatenate(parts)
            b = (e["t"] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            e, b = e[order], b[order]
            cut = np.flatnonzero(np.diff(b, prepend=-1))
            ends = np.append(cut[1:], len(b))
            return pa.RecordBatch.from_arrays([pa.array(b[cut], pa.int32()), pa.array([e[i:j].tobytes() for i, j in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary())], ["bucket", "blob"])

        parts: list[np.ndarray] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                if len(e := _entries(batch.slice(i, 4096), hot=False)):
                    parts.append(e)
                if sum(map(len, parts)) > 1_000_000:
                    yield out(parts)
                    parts = []
        if parts:
            yield out(parts)

    return run


def may_link(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Length and position bounds of sets of n and m tokens that share the tokens at places i and j."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - i, m - j) >= needed(n, m, percent))


def _lists(percent: int):
    """Candidates of each bucket's lists: (x, y) pairs, and the entries (t, x, n, i) of lists with a leader."""

    def work(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.frombuffer(b"".join(parts), ENTRY)
        e = e[np.argsort(e["t"], kind="stable")]
        same = np.diff(e["t"]) == 0
        e = e[np.append(same, False) | np.append(False, same)]
        e = e[np.lexsort((e["x"], e["i"], e["t"]))]
        if not len(e):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), e
        begin = np.flatnonzero(np.append(True, np.diff(e["t"]) != 0))
        size = np.diff(np.append(begin, len(e)))
        large = np.repeat(size > SMALL_LIST, size)
        pairs = []
        for d in range(1, SMALL_LIST):
            a = np.flatnonzero((e["t"][d:] == e["t"][:-d]) & ~large[d:]) if len(e) > d else []
            pairs.append((np.asarray(a, np.int64), np.asarray(a, np.int64) + d))
        b = np.flatnonzero(large)
        pairs.append((np.repeat(begin, size)[b], b))
        a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
        ok = (e["x"][a] != e["x"][b]) & may_link(e["n"][a], e["i"][a], e["n"][b], e["i"][b], percent)
        x, y = e["x"][a[ok]], e["x"][b[ok]]
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1) if len(x) else np.zeros((2, 0), np.int64)
        return both[0], both[1], e[large]

    def batch_of(x, y, e) -> pa.RecordBatch:
        none = lambda n, k: pa.nulls(n, k)
        p, q = len(x), len(e)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([none(p, pa.int64()), pa.array(e["t"].view(np.int64))]),
                pa.concat_arrays([pa.array(x), pa.array(np.ascontiguousarray(e["x"]))]),
                pa.concat_arrays([pa.array(y), none(q, pa.int64())]),
                pa.concat_arrays([none(p, pa.int32()), pa.array(np.ascontiguousarray(e["n"]))]),
                pa.concat_arrays([none(p, pa.int32()), pa.array(np.ascontiguousarray(e["i"]))]),
            ],
            ["t", "x", "y", "n", "i"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != at and parts:
                    yield batch_of(*work(parts))
                    parts = []
                at = b
                parts.append(blob.as_py())
        if parts:
            yield batch_of(*work(parts))

    return run


def _hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            e = _entries(batch.slice(i, 4096), hot=True)
            if len(e):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[c]).view(k)) for c, k in (("t", np.int64), ("x", np.int64), ("n", np.int32), ("i", np.int32))], ["t", "x", "n", "i"])


def _bounds(percent: int, a: str = "", b: str = "_") -> str:
    """``may_link`` as SQL over columns n, i and n_, i_."""
    n, m, i, j = f"cast(n{a} as long)", f"cast(n{b} as long)", f"i{a}", f"i{b}"
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and least({n} - {i}, {m} - {j}) * {100 + percent} >= {percent} * ({n} + {m})"


def _set_rows(k: int, wanted):
    """(x, set) of the wanted documents; wanted None: of all rows given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = None if wanted is None else wanted.value
        for batch in batches:
            if ids is not None:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(among(own, ids)))
            own, rows, sets, held = batch.column(0), [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([own.take(pa.array(rows, pa.int64())), pa.array(sets, pa.binary())], ["x", "set"])

            for r, s in sets_of(batch, k):
                rows.append(r)
                sets.append(s.tobytes())
                held += s.nbytes
                if held >= SENT:
                    yield out()
                    rows, sets, held = [], [], 0
            if rows:
                yield out()

    return run


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            y, part, kind, x = (batch.column(i).to_pylist() for i in range(4))
            sets = batch.column(4)
            for r in range(batch.num_rows):
                if (y[r], part[r]) != key:
                    key, leaders = (y[r], part[r]), []
                s = np.frombuffer(sets[r].as_buffer(), "<u8")
                if kind[r] == 0:
                    leaders.append(s)
                    continue
                for leader in leaders:
                    shared = int(among(s, leader).sum()) if len(s) <= len(leader) else int(among(leader, s).sum())
                    if 100 * shared >= percent * (len(s) + len(leader) - shared):
                        out.append((x[r], y[r]))
                        break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def verify(pairs: DataFrame, docs: DataFrame, scratch: Scratch, k: int, percent: int, name: str) -> DataFrame:
    """The pairs (x, y) whose sets link, as edges (a, b). ``pairs`` is a written table."""
    spark = pairs.sparkSession
    ids = scratch.save(pairs.select("x").union(pairs.select("y")).distinct(), f"{name}_ids")
    given = docs.select(F.col("doc_id").cast("long").alias("x"), "text").where("x is not null")
    if ids.count() <= BROADCAST_IDS:
        wanted = spark.sparkContext.broadcast(np.sort(ids.toPandas()["x"].to_numpy(np.int64)))
        sets = given.mapInArrow(_set_rows(k, wanted), "x long, set binary")
    else:
        sets = given.join(ids, "x", "left_semi").mapInArrow(_set_rows(k, None), "x long, set binary")
    sets = scratch.save(sets, f"{name}_sets")
    # of a pair, the document with more pairs leads; its set goes to each part of its group once
    degree = pairs.select("x").union(pairs.select("y")).groupBy("x").count()
    both = pairs.join(degree.withColumnRenamed("count", "dx"), "x").join(degree.select(F.col("x").alias("y"), F.col("count").alias("dy")), "y")
    led = F.col("dx") > F.col("dy")
    both = both.select(F.when(led, F.col("x")).otherwise(F.col("y")).alias("y"), F.when(led, F.col("y")).otherwise(F.col("x")).alias("x"), F.greatest("dx", "dy").alias("d"))
    both = both.select("y", F.pmod(F.xxhash64("x"), F.ceil(F.col("d") / GROUP)).cast("int").alias("part"), "x")
    members = both.join(sets, "x").select("y", "part", F.lit(1).alias("kind"), "x", "set")
    heads = both.select("y", "part").distinct().join(sets.withColumnRenamed("x", "y"), "y").select("y", "part", F.lit(0).alias("kind"), F.col("y").alias("x"), "set")
    rows = members.unionByName(heads).repartition("y", "part").sortWithinPartitions("y", "part", "kind")
    edges = scratch.save(rows.mapInArrow(_compare(percent), "a long, b long"), name)
    scratch.drop(f"{name}_sets", f"{name}_ids")
    return edges


def link(docs: DataFrame, scratch: Scratch, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (the smallest doc_id with the same set) of each row."""
    spark = docs.sparkSession
    buckets = max(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = spark.sparkContext.broadcast(common_tokens(docs, scratch, k, "common"))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.save(given.mapInArrow(_signatures(k, percent, hot), "doc_id long, n int, fp binary, cold int, prefix binary, sketch binary"), "rows")
    reps = rows.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("cold").alias("cold"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    reps = scratch.save(reps, "reps")

    lists = reps.mapInArrow(_blobs(buckets), "bucket int, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    lists = scratch.save(lists.mapInArrow(_lists(percent), "t long, x long, y long, n int, i int"), "lists")
    hot_rows = scratch.save(reps.where(F.col("cold") * 8 < F.octet_length("prefix")).mapInArrow(_hot_rows, "t long, x long, n int, i int"), "hot")
    order = (F.col("i").cast("long") * F.lit(1 << 32) + F.col("n")).alias("o")
    leaders = hot_rows.groupBy("t").agg(F.count("*").alias("c"), F.min_by("x", order).alias("x_"), F.min(order).alias("o")).where("c > 1")
    leaders = leaders.select("t", "x_", F.shiftright("o", 32).cast("int").alias("i_"), F.col("o").bitwiseAND((1 << 32) - 1).cast("int").alias("n_"))
    starred = hot_rows.join(leaders, "t").where("x <> x_").where(_bounds(percent)).select(F.least("x", "x_").alias("x"), F.greatest("x", "x_").alias("y"))
    pairs = scratch.save(alike(lists.where("t is null").select("x", "y").unionByName(starred).distinct(), reps, percent), "pairs")
    edges = verify(pairs, docs, scratch, k, percent, "edges")
    found = scratch.save(components(edges, scratch, "near"), "found")

    # lists whose sets lie in several components still
    opened = hot_rows.unionByName(lists.where("t is not null").select("t", "x", "n", "i"))
    named = opened.join(found, opened.x == found.node, "left").select("t", "x", "n", "i", F.coalesce("component", "x").alias("c"))
    several = named.groupBy("t").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("t")
    named = scratch.save(named.join(several, "t", "left_semi"), "open")
    if not named.isEmpty():
        largest = named.groupBy("t", "c").count().groupBy("t").agg(F.max_by("c", "count").alias("largest"))
        minor = named.join(largest, "t").where("c <> largest").drop("largest")
        other = named.select("t", *[F.col(c).alias(f"{c}_") for c in ("x", "n", "i", "c")])
        more = minor.join(other, "t").where("c <> c_").where(_bounds(percent)).select(F.least("x", "x_").alias("x"), F.greatest("x", "x_").alias("y")).distinct()
        more = scratch.save(alike(more.join(pairs, ["x", "y"], "left_anti"), reps, percent), "more")
        if not more.isEmpty():
            late = verify(more, docs, scratch, k, percent, "late")
            # the first components stand for their edges
            stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = scratch.save(components(stars.unionByName(late), scratch, "all"), "found_all")
    scratch.drop("lists", "hot", "open")
    classes = reps.select("fp", "rep").join(found, F.col("rep") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n", "fp").join(classes, "fp", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id")).alias("component_id"), F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("rep", "doc_id")).alias("class_id"))


def keep_one(docs: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """The rows of ``docs`` of each component's smallest doc_id, and those without a doc_id."""
    gone = scratch.save(link(docs, scratch, k, percent).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
