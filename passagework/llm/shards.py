"""Shards by a hierarchical weighted hash tree.

A row descends from the root through region, rack and shard. At each node every child draws a hash of the key, the
node and the child, weighted by the shards below the child, and the highest draw takes the row. A child's draw
depends on its own weight alone, so a change of weight moves rows only into or out of that child's subtree.
``grow`` adds the new shard as a region of its own: the old regions' draws stay, and rows move only into it.

The law is `key`: doc_id and the number of shards decide. Slots number a shard's rows by block, doc_id, checksum
and size; blocks are hashes, counted apart and numbered from running totals, so that no task sorts a whole shard.

Nulls: a null text has 0 bytes; a null doc_id draws by the text's checksum. Repeated rows get the same shard and
different slots. Extra columns are ignored. An empty table gives no rows. All is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

Tree = dict[str, "Tree | float"]
#: Blocks of a shard for numbering: the table of totals has shards x BLOCKS rows at most.
BLOCKS = 2048


def uniform_tree(regions: int = 2, racks: int = 3, shards: int = 4) -> Tree:
    return {f"r{r}": {f"k{k}": {f"s{s}": 1.0 for s in range(shards)} for k in range(racks)} for r in range(regions)}


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return tree | {f"r{len(tree)}": {"k0": {"s0": weight}}}


def weight(node: Tree | float) -> float:
    return node if isinstance(node, (int, float)) else sum(map(weight, node.values()))


def count_shards(node: Tree | float) -> int:
    return 1 if isinstance(node, (int, float)) else sum(map(count_shards, node.values()))


def draw(key: Column, path: str, w: float) -> Column:
    """ln(u) / w, with u in (0, 1) from 52 bits of a digest of the key and the child's path."""
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + path))), 1, 13), 16, 10).cast("double")
    return F.ln((digits + 0.5) / 2.0**52) / F.lit(float(w))


def descend(key: Column, node: Tree | float, path: str = "", first: int = 0) -> Column:
    """Number of the shard where ``key`` ends; shards are numbered in the tree's order."""
    if isinstance(node, (int, float)):
        return F.lit(first)
    numbers, at = [], first
    for child in node.values():
        numbers.append(at)
        at += count_shards(child)
    if len(node) == 1:
        (name, child), = node.items()
        return descend(key, child, f"{path}/{name}", first)
    draws = [F.struct(draw(key, f"{path}/{name}", weight(child)).alias("d"), F.lit(-i).alias("i")) for i, (name, child) in enumerate(node.items())]
    best = F.greatest(*draws)["i"]
    out = None
    for i, ((name, child), number) in enumerate(zip(node.items(), numbers, strict=True)):
        below = descend(key, child, f"{path}/{name}", number)
        out = F.when(best == -i, below) if out is None else out.when(best == -i, below)
    return out


def shard(docs: DataFrame, scratch: Scratch, tree: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row."""
    tree = tree or uniform_tree()
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    rows = rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("crc"), F.col("text_crc32").cast("string"))))
    old, region = descend(F.col("_key"), tree), len(tree)
    # the grown tree's root has one more child; its old children's draws, and all below, are the same
    new_draw = draw(F.col("_key"), f"/r{region}", 1.0)
    old_draw = F.greatest(*[draw(F.col("_key"), f"/{name}", weight(child)) for name, child in tree.items()])
    rows = rows.select("doc_id", "size", "text_crc32", old.alias("shard"), (new_draw > old_draw).alias("_moves"), F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(BLOCKS)).cast("int").alias("_block"))
    rows = scratch.save(rows, "shards")
    totals = rows.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("shard", "_block", before.alias("_before"))
    number = F.row_number().over(W.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("_in", number).join(F.broadcast(totals), ["shard", "_block"])
    grown = F.when(F.col("_moves"), F.lit(count_shards(tree))).otherwise(F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_before") + F.col("_in") - 1).cast("long").alias("slot"), grown.cast("int").alias("grown_shard"))
