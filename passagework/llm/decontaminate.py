"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index maps a word's hash to postings in item order, cut into blocks of ``BLOCK`` items with the greatest impact
in each. An impact is the BM25 share of a word, divided by the score that the item itself would get, so one
threshold serves items of any length. A passage is ``2 * stride`` words, a new one every ``stride`` words, where the
stride is the longest item's length: every stretch as long as an item lies whole in some passage.

All words of a run of texts are looked up at once, and the block maxima of their postings are summed for each passage
and block; a block that can't reach the threshold is skipped whole. The lists of a passage's other blocks run WAND:
the pivot is the first item that the sorted lists' bounds can lift over the threshold, the block's own bounds are
tried next, and only then is an item scored in full. Every item over the threshold is retrieved; there is no top k.

An item retrieved is a leak if ``overlap`` or more of the five-word shingles of its question and of its answer stand
in the passage. Where items have one text, its last quarter (five words at least) counts as the answer.

Words are runs of letters and digits, A-Z as a-z, so case, marks and line breaks don't hide a leak. The index is
broadcast; ``MAX_ITEM_WORDS`` bounds one part of it, and a larger benchmark is queried part after part, each part with
the document frequencies, mean length and stride of the whole benchmark, so that its size changes no score.

Nulls: a null or empty text, and an item with fewer words than a shingle, leak nothing but whole equal sequences: an
item of one to four words is one shingle. Items without words are ignored. A null item_id or doc_id is kept in the
result. Repeated rows give equal results, which are returned once; of passages with equal scores the one with more of
the question is taken. Extra columns are ignored. Empty tables give no rows. A text is held whole in a worker, with some
30 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, find_words, shingles, slices

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE = 0.7, 0.8, 5
BLOCK = 4
#: Sums of block maxima held at once.
HELD = 4_000_000
LEAST_STRIDE = 64
#: Words of the items in one index; some 60 bytes each on every executor.
MAX_ITEM_WORDS = 1_000_000


@dataclass
class Index:
    ids: list
    terms: np.ndarray  # sorted hashes
    first: np.ndarray  # first posting of a term, one more at the end
    items: np.ndarray
    impacts: np.ndarray
    most: np.ndarray  # greatest impact of a term
    first_block: np.ndarray  # first block of a term, one more at the end
    block: np.ndarray
    block_most: np.ndarray  # greatest impact of a term in a block
    parts: list[tuple[np.ndarray, np.ndarray]]  # shingles of question and answer
    stride: int


def _text_words(texts: list[str | None]) -> tuple[Words, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return find_words(np.frombuffer(b"".join(raw), np.uint8), off, bare=True), off


def _shingle_set(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes)
    got, _, _ = shingles(Words(np.zeros(n, np.int64), np.zeros(n, np.int64), hashes, np.array([0, n])), SHINGLE)
    return np.unique(got)


@dataclass
class Stats:
    """Of all items: how many hold each term, how many there are, and their words."""

    terms: np.ndarray
    df: np.ndarray
    items: int = 0
    words: int = 0
    longest: int = 0

    def add(self, rows: list[tuple]) -> None:
        sets = [np.unique(r[1]) for r in rows]
        found, n = np.unique(np.concatenate([np.repeat(self.terms, 0), *sets]), return_counts=True)
        both = np.union1d(self.terms, found)
        df = np.zeros(len(both), np.int64)
        df[np.searchsorted(both, self.terms)] += self.df
        df[np.searchsorted(both, found)] += n
        self.terms, self.df = both, df
        self.items += len(rows)
        self.words += sum(len(r[1]) for r in rows)
        self.longest = max([self.longest, *(len(r[1]) for r in rows)])

    @property
    def stride(self) -> int:
        return max(LEAST_STRIDE, self.longest)


def no_stats() -> Stats:
    return Stats(np.zeros(0, np.uint64), np.zeros(0, np.int64))


def parse_items(items: list[tuple]) -> list[tuple]:
    """(id, words, shingles of the question, of the answer) of each (id, question, answer or None) with words."""
    rows = []
    for at in range(0, len(items), 1000):
        some = items[at : at + 1000]
        q, _ = _text_words([x[1] for x in some])
        a, _ = _text_words([x[2] for x in some])
        for i, (ident, _, answer) in enumerate(some):
            question, reply = q.hash[q.first[i] : q.first[i + 1]], a.hash[a.first[i] : a.first[i + 1]]
            whole = np.concatenate([question, reply])
            if answer is None and len(whole) >= 2 * SHINGLE:
                cut = len(whole) - max(SHINGLE, len(whole) // 4)
                question, reply = whole[:cut], whole[cut:]
            if len(whole):
                rows.append((ident, whole, _shingle_set(question), _shingle_set(reply)))
    return rows


def build_index(rows: list[tuple], stats: Stats) -> Index | None:
    """Of parsed items, which may be a part of those that ``stats`` is of."""
    if not rows:
        return None
    size = np.array([len(r[1]) for r in rows])
    flat = np.concatenate([r[1] for r in rows])
    pairs, tf = np.unique(np.stack([flat, np.repeat(np.arange(len(rows)), size).astype(np.uint64)]), axis=1, return_counts=True)
    term, item = pairs[0], pairs[1].astype(np.int64)
    terms, first, own = np.unique(term, return_index=True, return_counts=True)
    df = stats.df[np.searchsorted(stats.terms, terms)]
    idf = np.repeat(np.log1p((stats.items - df + 0.5) / (df + 0.5)), own)
    impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] * stats.items / stats.words))
    impact = impact / np.bincount(item, impact)[item]
    most = np.maximum.reduceat(impact, first)
    of = np.repeat(np.arange(len(terms)), own)
    start = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)))
    first_block = np.searchsorted(of[start], np.arange(len(terms) + 1))
    return Index([r[0] for r in rows], terms, np.append(first, len(term)), item, impact, most, first_block, item[start] // BLOCK, np.maximum.reduceat(impact, start), [(r[2], r[3]) for r in rows], stats.stride)


def wand(index: Index, terms: list[int], threshold: float, blocks: list[int]) -> list[tuple[int, float]]:
    """(item, score) of every item of the blocks that scores ``threshold`` or more for the distinct terms."""
    lists = []
    for t in terms:
        a, b = index.first[t], index.first[t + 1]
        most = dict(zip(index.block[index.first_block[t] : index.first_block[t + 1]].tolist(), index.block_most[index.first_block[t] : index.first_block[t + 1]].tolist(), strict=True))
        ids, impacts = [], []
        for block in blocks:
            if block in most:
                i, j = a + np.searchsorted(index.items[a:b], [block * BLOCK, (block + 1) * BLOCK])
                ids += index.items[i:j].tolist()
                impacts += index.impacts[i:j].tolist()
        if ids:
            lists.append((ids, impacts, max(most[x] for x in blocks if x in most), most))
    at = [0] * len(lists)
    live, out, slack = list(range(len(lists))), [], threshold * (1 - 1e-9)
    while live:
        live.sort(key=lambda x: lists[x][0][at[x]])
        bound, pivot = 0.0, -1
        for place, x in enumerate(live):
            bound += lists[x][2]
            if bound >= slack:
                pivot = place
                break
        if pivot < 0:
            break
        item = lists[live[pivot]][0][at[live[pivot]]]
        while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == item:
            pivot += 1
        block = item // BLOCK
        reach = sum(lists[x][3].get(block, 0.0) for x in live[: pivot + 1])
        if reach < slack:
            target = (block + 1) * BLOCK  # no item of this block that only these lists hold can do
            if pivot + 1 < len(live):
                target = min(target, lists[live[pivot + 1]][0][at[live[pivot + 1]]])
            target = max(target, item + 1)
        elif lists[live[0]][0][at[live[0]]] == item:
            score = sum(lists[x][1][at[x]] for x in live[: pivot + 1])
            if score >= slack:
                out.append((item, score))
            target = item + 1
        else:
            target = item
        for x in live[: pivot + 1]:
            ids, p = lists[x][0], at[x]
            while p < len(ids) and ids[p] < target:
                p += 1
            at[x] = p
        live = [x for x in live if at[x] < len(lists[x][0])]
    return out


def _open_blocks(index: Index, terms: np.ndarray, begin: np.ndarray, threshold: float) -> Iterator[tuple[int, list[int]]]:
    """(passage, blocks) of the passages that may reach the threshold in some block."""
    n_blocks = -(-len(index.ids) // BLOCK)
    passages = len(begin) - 1
    step = max(1, HELD // n_blocks)
    for i in range(0, passages, step):
        j = min(i + step, passages)
        t = terms[begin[i] : begin[j]]
        n = index.first_block[t + 1] - index.first_block[t]
        place = np.repeat(index.first_block[t], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.repeat(np.arange(j - i), np.diff(begin[i : j + 1])), n)
        bound = np.bincount(at * n_blocks + index.block[place], index.block_most[place], minlength=(j - i) * n_blocks).reshape(-1, n_blocks)
        some: dict[int, list[int]] = {}
        for x, block in np.argwhere(bound >= threshold * (1 - 1e-9)).tolist():
            some.setdefault(x, []).append(block)
        yield from ((i + x, blocks) for x, blocks in some.items())


def _overlap(part: np.ndarray, passage: np.ndarray) -> float:
    return 1.0 if not len(part) else float(np.isin(part, passage).mean())


HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _search(shared, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        stride = index.stride
        for batch in batches:
            ids, out = batch.column(0), {}
            for i, j, raw, off in slices(batch):
                w = find_words(raw, off, bare=True)
                if not len(w.hash):
                    continue
                text = w.text_of
                place = np.searchsorted(index.terms, w.hash)
                place[place == len(index.terms)] = 0
                known = np.flatnonzero(index.terms[place] == w.hash)
                if not len(known):
                    continue
                # cells of stride words; a passage is a cell and the next
                cells = -(-np.diff(w.first) // stride)
                base = np.cumsum(cells) - cells
                cell = base[text[known]] + (known - w.first[text[known]]) // stride
                of = np.repeat(np.arange(len(cells)), cells)
                after = np.append(of[1:] == of[:-1], False)
                # a word is in the passage of its cell and in that of the cell before; a text's last cell is a
                # passage of its own only where it is the first as well
                last = ~after[cell] & (cell != base[text[known]])
                before = np.flatnonzero(cell != base[text[known]])
                c = np.concatenate([cell[~last], cell[before] - 1])
                t = np.concatenate([place[known][~last], place[known][before]])
                key = np.unique(c * len(index.terms) + t)
                c, t = key // len(index.terms), key % len(index.terms)
                begin = np.searchsorted(c, np.arange(len(of) + 1))
                for x, blocks in _open_blocks(index, t, begin, threshold):
                    terms = t[begin[x] : begin[x + 1]]
                    found = wand(index, terms.tolist(), threshold, blocks)
                    if not found:
                        continue
                    r = int(of[x])
                    a = w.first[r] + (x - base[r]) * stride
                    passage = _shingle_set(w.hash[a : min(a + 2 * stride, w.first[r + 1])])
                    for item, score in found:
                        q, p = (_overlap(part, passage) for part in index.parts[item])
                        if q >= overlap and p >= overlap and score > out.get((i + r, item), (0.0,))[0]:
                            out[(i + r, item)] = (score, q, p)
            if out:
                rows = list(out)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([r for r, _ in rows], pa.int64())), pa.array([index.ids[k] for _, k in rows], pa.int64()), *[pa.array([out[r][c] for r in rows], pa.float64()) for c in range(3)]], [f.split()[0] for f in HITS.split(", ")])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, item_id, score and the overlaps of every leak: one row for a document and item, that of its best
    passage. ``benchmark`` has item_id and text, or item_id, question and answer."""
    spark = docs.sparkSession
    fields = ("question", "answer") if "question" in benchmark.columns else ("text",)
    asked = benchmark.select(F.col("item_id").cast("long"), *fields)

    def parts() -> Iterator[list[tuple]]:
        """Parsed items, a part at a time: test items are a stated set."""
        part, words = [], 0
        for row in asked.toLocalIterator():
            part.append((row[0], row[1], row[2] if len(row) > 2 else None))
            words += sum(len((x or "").split()) for x in row[1:])
            if words >= MAX_ITEM_WORDS:
                yield parse_items(part)
                part, words = [], 0
        yield parse_items(part)

    stats, found, first = no_stats(), None, None
    for n, rows in enumerate(parts()):
        stats.add(rows)
        first = rows if n == 0 else None
    # all parts have the statistics of the whole benchmark; where there is one, it isn't read again
    for rows in parts() if first is None else [first]:
        index = build_index(rows, stats)
        if index is not None:
            shared = spark.sparkContext.broadcast(index)
            more = docs.select(F.col(doc_id).cast("long"), F.col("text").cast("string")).mapInArrow(_search(shared, threshold, overlap), HITS)
            found = more if found is None else found.unionByName(more)
    if found is None:
        return spark.createDataFrame([], HITS)
    return found.groupBy("doc_id", "item_id").agg(*[F.round(F.max_by(c, F.struct("score", "question_overlap", "answer_overlap")), 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def drop_leaking(docs: DataFrame, benchmark: DataFrame, scratch) -> DataFrame:
    """The rows of ``docs`` without a leak."""
    found = scratch.save(leaks(docs, benchmark).select("doc_id").where("doc_id is not null").distinct(), "leaks")
    small = found.count() <= 2_000_000
    return docs.join(F.broadcast(found) if small else found, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
