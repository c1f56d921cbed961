"""Search by file and folder names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import NAME_COMMON_SHARE
from ..sources.scratch import Scratch
from . import keyword, postings, units

KEY = ["path"]


def search(queries: DataFrame, files: DataFrame, first_passages: DataFrame, limit: int, share: float = NAME_COMMON_SHARE) -> DataFrame:
    """query_id, rank, path, hash, ordinal (of the file's first passage), score and matched. Words in no path, or in
    more than ``share`` of all, are ignored; of n others a path must hold ceil(n / 2), two at least, or the only one.
    Files without a passage are never found."""
    sizes = postings.lengths(files, KEY, "path")
    stats = postings.stats(sizes)
    words = asked_words(queries)
    index = postings.postings(files, KEY, "path", only=keyword.wanted_terms(words))
    found = keyword.matches(words, index, KEY)
    holding = found.groupBy("query_id", "no").agg(F.count("*").alias("h")).join(F.broadcast(stats.select("n_units"))).where(F.col("h") <= F.col("n_units") * share)
    kept = found.join(holding.select("query_id", "no"), ["query_id", "no"])
    needs = holding.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.greatest(F.least("n", F.lit(2)), F.ceil(F.col("n") / 2)).alias("needed"))
    scored = keyword.bm25(kept, sizes, stats, KEY, spellings=True).join(F.broadcast(needs), "query_id")
    shown = scored.join(files.select("path", "hash"), "path").join(first_passages.select("hash", "ordinal"), "hash")
    best = keyword.top(shown, KEY, 5 * limit + 20).drop("rank").where("matched >= needed")
    return keyword.top(best, KEY, limit).select("query_id", F.col("rank").cast("long").alias("rank"), "path", "hash", "ordinal", "score", "matched")


def asked_words(queries: DataFrame) -> DataFrame:
    words = queries.select("query_id", F.posexplode(X.distinct_words(F.regexp_replace("query", r"\p{Cc}", " "))).alias("no", "text"))
    return words.select("query_id", F.lit("word").alias("kind"), F.col("no").cast("long").alias("no"), "text")


class _Paths(keyword.Units):
    """Paths as units; ``has_words`` tells whose file has a passage."""

    def kept(self, rows: list[Row]) -> tuple[list[Row], int]:
        left = [r for r in rows if 0 < self.doc_of.get(tuple(r.tokens), 0) <= self.of.n_units * self.share]
        return left, max(min(len(left), 2), -(-len(left) // 2))


def search_units(queries: DataFrame, files: DataFrame, limit: int, scratch: Scratch, share: float = NAME_COMMON_SHARE) -> DataFrame:
    """What ``search`` gives, for whole tables of ``files`` (path, hash, has_words): a path is read once, as a passage
    is. A file with words has a first passage, of ordinal 0."""
    rows, asked = keyword.asked_terms(asked_words(queries))
    paths = files.select(F.col("path").alias("hash"), F.col("path").alias("text"), F.col("hash").alias("content"), "has_words")
    read = units.units(paths, asked, 1 << 40, 0, False, carry=("content", "has_words"))
    read = scratch.save(read.withColumnsRenamed({"hash": "path", "content": "hash"}), "paths")
    found = _Paths(rows, asked, read, ["path", "hash"], share)
    found.units = read.where("has_words")
    return found.search(limit).withColumn("ordinal", F.lit(0).cast("long"))


def first_passages(passages: DataFrame) -> DataFrame:
    return passages.groupBy("hash").agg(F.min("ordinal").alias("ordinal"))
