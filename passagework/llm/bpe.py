"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task gathers the words (matches of the pattern) of a block of whole texts, keeps the distinct ones it
hasn't met, and lays their bytes out as one linked list of symbols. An inverted index maps each pair of
neighbouring tokens, by the rank of its merge, to the positions where it stands. The ranks are applied in order
through a heap; a merge touches only its two neighbours, whose new pairs go to the index. A merge can make a pair
of a lower rank than its own; the rest of that word's positions then go back to the index, so every word sees its
lowest rank first and its leftmost position first, as an encoder that handles one word at a time would.

A word that is itself in the vocabulary is one token. The texts' ids are the words' ids in order. Special tokens
are ordinary text. A text is held whole, with its words, in a worker.

Nulls: a null text is empty: no ids, and the digests of no bytes. Repeated rows each give a row. Extra columns
are kept unless they bear an output's name, which then has the output's value. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose ids a task remembers, and characters of text whose words are replayed together.
REMEMBERED_WORDS = 400_000
BLOCK_CHARS = 1_000_000
#: Whether C's unsigned int is little-endian with 32 bits.
NATIVE = sys.byteorder == "little" and array("I").itemsize == 4
#: Pairs of tokens whose merge a task remembers.
REMEMBERED_PAIRS = 500_000


class Vocabulary:
    """Ranks of a tiktoken file: one line for each token, its bytes in base64 and its id."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}
        # ids of what two bytes make
        self.two = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)

    def merged(self, a: int, b: int) -> int:
        """Id of the token that a and b make, or -1."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self.ranks.get(self.bytes[a] + self.bytes[b], -1)
        return got

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        table = self.bytes
        for i in range(0, len(ids), 1 << 16):
            yield b"".join([table[x] for x in ids[i : i + (1 << 16)].tolist()])


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def replay(words: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """Ids of each word, by applying every merge over all the words in rank order."""
    out: list[list[int]] = [[] for _ in words]
    open_ = []
    for w, word in enumerate(words):
        whole = vocab.ranks.get(word)
        if whole is None and word:
            open_.append(w)
        elif word:
            out[w] = [whole]
    size = np.array([len(words[w]) for w in open_], np.int64)
    raw = np.frombuffer(b"".join([words[w] for w in open_]), np.uint8)
    total = len(raw)
    ends = np.cumsum(size)
    token: list[int] = np.array(vocab.single)[raw].tolist()
    word_of: list[int] = np.repeat(open_, size).tolist()
    begins: list[int] = (ends - size).tolist()
    link = np.arange(1, total + 1)
    link[ends - 1] = total
    after: list[int] = link.tolist()
    link = np.arange(-1, total - 1)
    link[begins] = -1
    before: list[int] = link.tolist()
    # where each pair of neighbouring bytes stands, by the rank of its merge
    rank_of = np.full(total, -1, np.int64)
    rank_of[:-1] = vocab.two[raw[:-1].astype(np.int64) << 8 | raw[1:]] if total else -1
    rank_of[ends - 1] = -1
    place = np.flatnonzero(rank_of >= 0)
    place = place[np.argsort(rank_of[place], kind="stable")]
    ranks, cut = np.unique(rank_of[place], return_index=True)
    index: dict[int, list[int]] = {r: x.tolist() for r, x in zip(ranks.tolist(), np.split(place, cut[1:]), strict=True)} if len(ranks) else {}
    merged = vocab.merged
    queue = list(index)
    heapq.heapify(queue)
    while queue:
        rank = heapq.heappop(queue)
        places = index.pop(rank, None)
        if not places:
            continue
        places.sort()
        held: set[int] = set()
        again: list[int] = []
        for i in places:
            if held and word_of[i] in held:
                again.append(i)
                continue
            j = after[i]
            if token[i] < 0 or j >= total or merged(token[i], token[j]) != rank:
                continue
            token[i], token[j] = rank, -1
            k = after[i] = after[j]
            if k < total:
                before[k] = i
                if (r := merged(rank, token[k])) >= 0:
                    if r in index:
                        index[r].append(i)
                    else:
                        heapq.heappush(queue, r)
                        index[r] = [i]
                    if r <= rank:
                        held.add(word_of[i])
            h = before[i]
            if h >= 0 and (r := merged(token[h], rank)) >= 0:
                if r in index:
                    index[r].append(h)
                else:
                    heapq.heappush(queue, r)
                    index[r] = [h]
                if r <= rank:
                    held.add(word_of[i])
        if again:
            if rank in index:
                index[rank] += again
            else:
                heapq.heappush(queue, rank)
                index[rank] = again
    for b in begins:
        i, ids = b, out[word_of[b]]
        while i < total:
            ids.append(token[i])
            i = after[i]
    return out


class Encoder:
    """Encodes texts, remembering the ids of words already replayed."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.known: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED_WORDS:
            self.known.clear()
            new = list(words)
        for w, ids in zip(new, replay([w.encode() for w in new], self.vocab), strict=True):
            self.known[w] = array("I", ids).tobytes() if NATIVE else np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.vocab.pattern.findall(t) for t in texts]
        self.learn(set().union(*split) if split else set())
        known = self.known
        return [b"".join([known[w] for w in words]) for words in split]


def _rows(path: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        encoder = Encoder(vocab)

        def block(ids: list, texts: list[str]) -> pa.RecordBatch:
            coded = encoder.encode(texts)
            arrays = [np.frombuffer(x, "<u4") for x in coded]
            decoded = []
            for x in arrays:
                digest = hashlib.sha256()
                for piece in vocab.decode(x):
                    digest.update(piece)
                decoded.append(digest.hexdigest())
            columns = [*ids, pa.array([len(x) for x in arrays], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in coded]), pa.array(decoded)]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array([x.astype(np.int32) for x in arrays], pa.list_(pa.int32())))
                names.append("ids")
            return columns, names

        for batch in batches:
            at = batch.schema.get_field_index("_bpe_text")
            texts, i = batch.column(at), 0
            while i < len(texts):
                some, chars, j = [], 0, i
                while j < len(texts) and (not some or chars < BLOCK_CHARS):
                    some.append(texts[j].as_py() or "")
                    chars += len(some[-1])
                    j += 1
                rest = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns) if c != at]
                columns, names = block(rest, some)
                yield pa.RecordBatch.from_arrays(columns, [n for n in batch.schema.names if n != "_bpe_text"] + names)
                i = j

    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, keep_ids: bool = False) -> DataFrame:
    """One row for each row of ``docs``: the columns of ``keep`` (all but the text, by default), n_tokens,
    ids_sha256 and decoded_sha256, and with ``keep_ids`` the ids. The digests are of the ids as little-endian
    unsigned 32-bit integers and of the bytes that the ids decode to. ``path`` must exist on every executor."""
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made and (keep is not None or c != text)]
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_bpe_text"))
    fields = [T.StructField(f.name, f.dataType, True) for f in given.schema.fields if f.name != "_bpe_text"]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return given.mapInArrow(_rows(path, pattern, keep_ids), T.StructType(fields))
