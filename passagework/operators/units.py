"""Passages of whole texts as units of a search: their lengths, what they hold of the queries' terms and the counts of
their words' buckets, in one pass.

A worker reads each distinct word once (its tokens, by the rules of ``functions.text``, and its bucket); a text is then a
row of numbers, and passages, lengths, terms and phrases are found by sums and sorts over many texts at once. A text
without words, or null, has no passage; malformed bytes are no letters."""

from __future__ import annotations

import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..functions import text as X
from ..functions import vectors as V

#: Words that a worker keeps, and bytes of text that it takes at once (or one text).
KNOWN_WORDS = 1 << 19
BYTES_AT_ONCE = 8 << 20
_ASCII = re.compile("[A-Za-z0-9]+")
#: ASCII that is no letter or digit.
_EDGE = bytes(c for c in range(128) if not chr(c).isalnum())
_FOLD = str.maketrans(X.MARKED, X.PLAIN)
_DIMS = 64


def surfaces(word: str) -> list[str]:
    """``functions.text.surfaces`` of one word."""
    low = word.lower().replace("̇", "")
    if low.isascii():
        return _ASCII.findall(low)
    kinds = (unicodedata.category(c) for c in low)
    return "".join(c if k[0] in "LN" or k == "Co" else " " for c, k in zip(low, kinds, strict=True)).split(" ")


class _Words(dict):
    """Number of a word (bytes), with its tokens, bucket and wanted tokens by that number. Most words of a large table are
    rare, so those of one token take a short way."""

    def __init__(self, token_ids: dict[str, int], meaning: bool):
        self.token_ids, self.meaning = token_ids, meaning
        self.plain = {t.encode(): i for t, i in token_ids.items()}
        self.spelt: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.spelt.clear()
        self.sizes, self.buckets = array("i"), array("i")
        # wanted tokens of all words, one after the other: token, place in the word, spelling (0: as the token)
        self.firsts, self.held = array("q", [0]), array("q")

    def _hold(self, surface: str, at: int) -> None:
        term = surface.translate(_FOLD)
        token = self.token_ids.get(term)
        if token is not None:
            self.held.extend((token, at, 0 if surface == term else self.spelt.setdefault(surface, len(self.spelt) + 1)))

    def __missing__(self, raw: bytes) -> int:
        core, n, whole = raw.strip(_EDGE), 1, b""
        if core.isalnum():
            whole = core.lower()
            token = self.plain.get(whole)
            if token is not None:
                self.held.extend((token, 0, 0))
        else:
            word = core.decode("utf-8", "replace")
            low = word.lower()
            if low.isalnum():
                whole = low.encode()
                self._hold(low, 0)
            else:
                found = [s for s in surfaces(word) if s]
                n = len(found)
                for at, surface in enumerate(found):
                    self._hold(surface, at)
        self.firsts.append(len(self.held) // 3)
        self.sizes.append(n)
        if self.meaning:
            self.buckets.append(V.bucket_of(whole, _DIMS) if whole else V.bucket(core.decode("utf-8", "replace"), _DIMS))
        self[raw] = code = len(self)
        return code


#: The words of the last run, by its name: tasks of one run share them in a worker.
_LAST: dict[str, _Words] = {}


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each of ``size`` places from ``first``, for all rows."""
    rows = np.repeat(np.arange(len(size)), size)
    begun = np.cumsum(size) - size
    return rows, np.arange(len(rows)) - np.repeat(begun - first, size)


def _units(words: _Words, texts: list[np.ndarray], size: int, overlap: int, single: np.ndarray, pairs: np.ndarray, phrases: dict[int, list[tuple[int, list[int]]]], n_asked: int) -> tuple:
    """Text, ordinal, length, hits (unit, term, times, spellings) and bucket counts of the units of some texts."""
    n = np.array([len(t) for t in texts], np.int64)
    codes, begun = np.concatenate(texts), np.cumsum(n) - n
    of = np.where(n > size, -(-(n - size) // (size - overlap)) + 1, np.minimum(n, 1))
    text, ordinal = _spread(np.zeros(len(n), np.int64), of)
    start = begun[text] + ordinal * (size - overlap)
    end = np.minimum(start + size, begun[text] + n[text])
    tokens = np.concatenate([[0], np.cumsum(np.array(words.sizes)[codes], dtype=np.int64)])
    first_token, last_token = tokens[start], tokens[end]

    firsts = np.array(words.firsts)
    held = np.array(words.held).reshape(-1, 3)
    at = np.flatnonzero((firsts[1:] > firsts[:-1])[codes])
    word, place = _spread(firsts[codes[at]], (firsts[1:] - firsts[:-1])[codes[at]])
    token, spelling = held[place, 0], held[place, 2]
    where = tokens[at[word]] + held[place, 1]

    # single terms: in each unit, by term and spelling
    alone = single[token] >= 0
    term, spelt, stands = single[token[alone]], spelling[alone], where[alone]
    low, high = np.searchsorted(stands, first_token), np.searchsorted(stands, last_token)
    unit, place = _spread(low, high - low)
    n_spelt = len(words.spelt) + 1
    one, times = np.unique((unit * n_asked + term[place]) * n_spelt + spelt[place], return_counts=True)
    key = one // n_spelt
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    hits, tf, n_surfaces = key[cut], np.add.reduceat(times, cut) if len(cut) else times, np.diff(np.append(cut, len(key)))

    # phrases: their first two tokens side by side, then the others
    if len(pairs) and len(where) > 1:
        side = where[1:] == where[:-1] + 1
        code = token[:-1] * len(single) + token[1:]
        nth = np.searchsorted(pairs, code)
        begins = np.flatnonzero(side & (pairs[np.minimum(nth, len(pairs) - 1)] == code))
        placed = []
        for i in begins.tolist():
            for asked, whole in phrases[int(code[i])]:
                m = len(whole)
                if m == 2 or (i + m <= len(where) and where[i + m - 1] == where[i] + m - 1 and token[i : i + m].tolist() == whole):
                    placed.append((where[i], m, asked))
        if placed:
            from_, m, asked = np.array(placed, np.int64).T
            # units are in the order of their first and of their last tokens
            low, high = np.searchsorted(last_token, from_ + m), np.searchsorted(first_token, from_, side="right")
            which, unit = _spread(low, np.maximum(high - low, 0))
            many, times = np.unique(unit * n_asked + asked[which], return_counts=True)
            hits, tf, n_surfaces = np.append(hits, many), np.append(tf, times), np.append(n_surfaces, np.ones(len(many), np.int64))
            order = np.argsort(hits, kind="stable")
            hits, tf, n_surfaces = hits[order], tf[order], n_surfaces[order]

    counts = None
    if words.meaning:
        unit, place = _spread(start, end - start)
        buckets = np.array(words.buckets)[codes]
        counts = np.bincount(unit * (_DIMS + 1) + buckets[place], minlength=len(start) * (_DIMS + 1)).reshape(-1, _DIMS + 1)[:, :_DIMS]
    return text, ordinal, last_token - first_token, hits, tf, n_surfaces, counts


def units(texts: DataFrame, asked: list[tuple[str, ...]], size: int, overlap: int, meaning: bool, number: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """hash, ordinal, dl and hits (t, tf, n) of the passages that ``chunk_words`` gives of (hash, text), with ``meaning``
    the ``counts`` that ``vectors.vectors_of_counts`` takes. ``asked``: distinct terms, each its tokens; a hit has the
    term's place in it, how often it stands in the unit and in how many spellings (1 for one of several tokens).
    With ``number`` a column row, by which a text's row is told from others of the same hash in what is written; the
    columns ``carry`` of ``texts`` go along."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a passage needs words, and an overlap smaller than it")
    token_ids = {t: i for i, t in enumerate(sorted({t for a in asked for t in a}))}
    single = np.full(max(len(token_ids), 1), -1, np.int64)
    phrases: dict[int, list[tuple[int, list[int]]]] = {}
    for i, a in enumerate(asked):
        ids = [token_ids[t] for t in a]
        if len(ids) == 1:
            single[ids[0]] = i
        else:
            phrases.setdefault(ids[0] * len(single) + ids[1], []).append((i, ids))
    pairs = np.array(sorted(phrases), np.int64)
    names = ["hash", "ordinal", "dl", "hits", *["counts"] * meaning, *["row"] * number, *carry]
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    shared = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, token_ids, single, pairs, phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, token_ids, single, pairs, phrases = shared.value
        if name not in _LAST:
            _LAST.clear()
            _LAST[name] = _Words(token_ids, meaning)
        words = _LAST[name]
        task, seen = TaskContext.get().partitionId() << 40, 0

        carry_types: list[pa.DataType] = []

        def made(hashes: list[str], coded: list[np.ndarray], carried: list[tuple]) -> pa.RecordBatch:
            nonlocal seen
            n_asked = max(len(asked), 1)
            text, ordinal, dl, hits, tf, n_surfaces, counts = _units(words, coded, size, overlap, single, pairs, phrases, n_asked)
            bounds = np.searchsorted(hits, np.arange(len(text) + 1) * n_asked)
            fields = [pa.array(x.astype(np.int32)) for x in (hits % n_asked, tf, n_surfaces)]
            listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(fields, ["t", "tf", "n"]))
            columns = [pa.array(hashes, pa.string()).take(pa.array(text)), pa.array(ordinal), pa.array(dl), listed]
            if counts is not None:
                columns.append(pa.array([c.tobytes() for c in counts.astype("<u4")], pa.binary()))
            if number:
                columns.append(pa.array(task + seen + text))
                seen += len(coded)
            columns += [pa.array(c, kind).take(pa.array(text)) for c, kind in zip(zip(*carried, strict=True), carry_types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            hashes, coded, carried, taken = [], [], [], 0
            carry_types = [c.type for c in batch.columns[2:]]
            for h, t, *more in zip(*batch.columns, strict=True):
                raw = t.as_py()
                if not raw:
                    continue
                # bytes are split at the white space that the words of a text are
                coded.append(np.fromiter(map(words.__getitem__, raw.split()), np.int64))
                hashes.append(h.as_py())
                carried.append(tuple(c.as_py() for c in more))
                taken += len(raw)
                if taken >= BYTES_AT_ONCE or len(words) >= KNOWN_WORDS:
                    yield made(hashes, coded, carried)
                    hashes, coded, carried, taken = [], [], [], 0
                    if len(words) >= KNOWN_WORDS:
                        words.reset()
            if coded:
                yield made(hashes, coded, carried)

    schema = "hash string, ordinal long, dl long, hits array<struct<t: int, tf: int, n: int>>" + ", counts binary" * meaning + ", row long" * number + "".join(f", {c} {kinds[c]}" for c in carry)
    return texts.selectExpr("hash", "cast(text as binary) as text", *carry).mapInArrow(run, schema)
