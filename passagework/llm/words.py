"""Words and byte strings of Arrow batches as flat numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. A word's hash is a 64-bit
polynomial over its bytes. All work is done on slices of about ``SLICE`` bytes of whole texts, so memory
follows the longest single text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_FOLDED[_SPACE] = 0
#: For bare words ASCII marks divide as well.
_MARKS = _SPACE.copy()
_MARKS[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x = x * _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash's step."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 4096), _STEP, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; a null text is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


@dataclass
class Words:
    """Words of a slice: byte starts and ends, hashes, and first word of each text (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(raw: np.ndarray, off: np.ndarray, bare: bool = False) -> Words:
    """Words of a slice; ``bare``: runs of ASCII letters, digits and bytes beyond ASCII, where capitals of Latin-1
    count as small letters too."""
    divides = _MARKS if bare else _SPACE
    if bare and len(raw):
        capital = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)
        raw = raw.copy()
        raw[1:][capital] += 0x20
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(off), np.int64))
    word = ~divides[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = off[(off > 0) & (off < len(raw))]
    begins[edges] = word[edges]
    start = np.flatnonzero(begins)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(off), np.int64))
    length = np.add.reduceat(word, start, dtype=np.int64)
    span = np.diff(start, append=len(raw))
    place = np.arange(start[0], len(raw)) - np.repeat(start, span)
    value = np.where(word[start[0] :], _FOLDED[raw[start[0] :]], _U(0)) * powers(int(span.max()))[place]
    hashed = mix(np.add.reduceat(value, start - start[0]) ^ (length.astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
    return Words(start, start + length, hashed, np.searchsorted(start, off))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of every window of k words; a text of 1 to k-1 words gives one window of them all."""
    n = np.diff(words.first)
    h, total = words.hash, len(words.hash)
    size = np.maximum(n - k + 1, 0)
    text = np.repeat(np.arange(len(n)), size)
    at = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(words.first[:-1], size)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = out * _U(0x2545F4914F6CDD1D) + h[at + j] if total else out
    out = mix(out)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for x, t in enumerate(short):
            value = int(n[t])
            for w in h[words.first[t] : words.first[t + 1]].tolist():
                value = (value * 0x9FB21C651E98DF25 + w) & 0xFFFFFFFFFFFFFFFF
            extra[x] = value
        out, text, at = np.concatenate([out, mix(extra ^ _STEP)]), np.concatenate([text, short]), np.concatenate([at, words.first[short]])
        order = np.argsort(text, kind="stable")
        out, text, at = out[order], text[order], at[order]
    return out, text, at
