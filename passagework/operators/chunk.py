"""Overlapping passages of contents."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import CHUNK_OVERLAP, CHUNK_WORDS


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a passage needs words, and an overlap smaller than it")


def _ranges(n: Column, size: int, overlap: int) -> Column:
    """Starts of passages over n words: one where they fit, else as many strides as reach the end."""
    stride = size - overlap
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / stride).cast("int") + 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))


def chunk_words(contents: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, keep: tuple[str, ...] = ("hash",)) -> DataFrame:
    """ordinal, start_line, end_line and text of the passages of each row, a word counting as one token. A closed form
    of greedy filling, within the row: nothing is shuffled."""
    _check(size, overlap)
    lined = F.flatten(F.transform(X.lines(F.col("text")), lambda line, i: F.transform(X.words(line), lambda w: F.struct((i + 1).cast("long").alias("line"), w.alias("word")))))
    rows = contents.select(*keep, lined.alias("_w"))
    rows = rows.select(*keep, "_w", F.posexplode(_ranges(F.size("_w"), size, overlap)).alias("ordinal", "_at"))
    part = F.slice(F.col("_w"), F.col("_at") + 1, size)
    rows = rows.select(*keep, F.col("ordinal").cast("long").alias("ordinal"), part.alias("_p"))
    return rows.select(*keep, "ordinal", F.element_at("_p", 1)["line"].alias("start_line"), F.element_at("_p", -1)["line"].alias("end_line"), F.array_join(F.col("_p.word"), " ").alias("text"))


def chunk_texts(contents: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, keep: tuple[str, ...] = ("hash",)) -> DataFrame:
    """ordinal and text of the passages that ``chunk_words`` gives, without their lines. No function of it takes another
    one, so it is compiled as a whole and a text's words are copied into no passage's row."""
    _check(size, overlap)
    n, stride = F.size("_w"), size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / stride).cast("int"))
    ordinals = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = contents.select(*keep, X.words(F.col("text")).alias("_w")).select(*keep, "_w", F.explode_outer(ordinals).alias("_o"))
    return rows.where("_o is not null").select(*keep, F.col("_o").cast("long").alias("ordinal"), F.array_join(F.slice("_w", F.col("_o") * stride + 1, size), " ").alias("text"))


def chunk_pages(pages: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Passages of (hash, page, text): each page alone, ordinals running on over a content's pages."""
    cut = chunk_words(pages, size, overlap, keep=("hash", "page")).withColumnRenamed("ordinal", "_o")
    order = W.partitionBy("hash").orderBy("page", "_o")
    return cut.select("hash", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "page", "start_line", "end_line", "text")


#: Words whose tokens are counted in one call of a tokenizer.
COUNTED = 2_000


def weigh_by(offsets: Callable[[str], list[tuple[int, int]]]) -> Callable[[list[str]], list[int]]:
    """Word weights from a tokenizer that gives the character ranges of a text's tokens. ``COUNTED`` words go in one
    call, and a token counts for the word that holds its last character."""

    def weigh(words: list[str]) -> list[int]:
        out = [0] * len(words)
        for at in range(0, len(words), COUNTED):
            some = words[at : at + COUNTED]
            ends, total = [], 0
            for w in some:
                total += len(w) + 1
                ends.append(total)  # the space after a word goes with it
            for begin, end in offsets(" ".join(some)):
                if end > begin:
                    out[at + bisect.bisect_right(ends, end - 1)] += 1
        return out

    return weigh


def chunk_tokens(contents: DataFrame, weigh: Callable[[list[str]], list[int]], size: int, overlap: int) -> DataFrame:
    """Passages where a word weighs what ``weigh`` says, such as its tokens in a model. Filling is sequential, so it
    runs in Python, a batch of contents at a time; an over-long word is a passage of its own."""
    _check(size, overlap)

    def cut(text: str) -> list[tuple[int, int, str]]:
        spread = [(i, w) for i, line in enumerate(text.replace("\r\n", "\n").split("\n"), 1) for w in line.split()]
        cost = weigh([w for _, w in spread])
        out, at = [], 0
        while at < len(spread):
            end, total = at, 0
            while end < len(spread) and (end == at or total + cost[end] <= size):
                total += cost[end]
                end += 1
            out.append((spread[at][0], spread[end - 1][0], " ".join(w for _, w in spread[at:end])))
            if end == len(spread):
                break
            back, shared = end, 0
            while back - 1 > at and shared + cost[back - 1] <= overlap:
                back -= 1
                shared += cost[back]
            at = back
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, o, *p) for h, t in zip(batch["hash"], batch["text"], strict=True) for o, p in enumerate(cut(t or ""))]
            yield pd.DataFrame(rows, columns=["hash", "ordinal", "start_line", "end_line", "text"])

    return contents.select("hash", "text").mapInPandas(run, "hash string, ordinal long, start_line long, end_line long, text string")
