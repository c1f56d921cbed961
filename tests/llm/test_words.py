import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm import bpe
from passagework.llm.substrings import LENGTH, anchors, intervals, maximal_repeats
from passagework.llm.words import find_words, shingles, slices


def batch(texts):
    return pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAB é日\n\t .", max_size=40)), max_size=6))
def test_words_and_shingles(texts):
    for i, j, raw, off in slices(batch(texts), limit=30):
        words = find_words(raw, off)
        for r in range(j - i):
            want = [w for w in re.split(r"[\x20\x09-\x0d]+", texts[i + r] or "") if w]
            got = [raw[s:e].tobytes().decode() for s, e in zip(words.start[words.first[r] : words.first[r + 1]], words.end[words.first[r] : words.first[r + 1]], strict=True)]
            assert got == want
    seen, back = {}, {}
    for i, j, raw, off in slices(batch(texts), limit=30):
        h, text, _ = shingles(find_words(raw, off), 3)
        for r in range(j - i):
            w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.split(r"[\x20\x09-\x0d]+", texts[i + r] or "") if x]
            want = [tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
            got = h[text == r].tolist()
            assert len(got) == len(want)
            for g, x in zip(got, want, strict=True):
                assert seen.setdefault(g, x) == x and back.setdefault(x, g) == g


def test_bare_words_fold_latin_capitals():
    for _, _, raw, off in slices(batch(["ÉTÉ, étÉ!", "été été"])):
        words = find_words(raw, off, bare=True)
        assert len(set(words.hash.tolist())) == 1 and len(words.hash) == 4


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "a"])
def test_equal_strings_have_equal_anchors(alphabet):
    r = np.random.default_rng(3)
    text = "".join(r.choice(list(alphabet), 400))
    raw = np.frombuffer((text + "###" + text[100:260]).encode(), np.uint8)
    off = np.array([0, 400, 403, 563])
    _, of, a, first, last = anchors(raw, off)
    place = {}
    for t, x, lo, hi in zip(of.tolist(), a.tolist(), first.tolist(), last.tolist(), strict=True):
        for s in range(lo, hi + 1):
            assert off[t] <= s and s + LENGTH <= off[t + 1]
            place[s] = x - s
    assert len(place) == 351 + 111
    for s in range(403, 403 + 111):
        assert place[s] == place[s - 403 + 100]


def test_intervals_of_a_prefix_tree():
    rows = sorted(["banana$", "anana$", "nana$", "ana$", "na$", "a$"])
    common = [len([0 for x, y in zip(p, q, strict=False) if p[: p.index(x) + 1] == q[: p.index(x) + 1]]) for p, q in zip(rows, rows[1:], strict=False)]
    common = [next(k for k in range(9) if p[: k + 1] != q[: k + 1]) for p, q in zip(rows, rows[1:], strict=False)]
    got = {(d, rows[i][:d], j - i + 1) for d, i, j in intervals(common, len(rows)) if i < j and d}
    assert got == {(1, "a", 3), (3, "ana", 2), (2, "na", 2)}


def test_maximal_repeats_have_all_occurrences():
    sides = [("xyz", "abcd"), ("xyz", "abce"), ("wyz", "abcd"), ("qqq", "abzz")]
    left = np.array([[ord(c) for c in x[::-1]] for x, _ in sides], np.uint8)
    right = np.array([[ord(c) for c in y] for _, y in sides], np.uint8)
    got = {(more, depth, frozenset(rows.tolist())) for more, depth, rows in maximal_repeats(left, np.full(4, 3), right, np.full(4, 4), 5)}
    assert got == {(2, 4, frozenset({0, 2})), (2, 3, frozenset({0, 1, 2})), (3, 3, frozenset({0, 1}))}


@pytest.fixture(scope="module")
def vocab():
    tokenizers = pytest.importorskip("public_tokenizers")
    return bpe.vocabulary(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(max_size=120), min_size=1, max_size=5))
def test_merge_replay_is_the_library_encoding(vocab, texts):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=vocab.pattern.pattern, mergeable_ranks=vocab.ranks, special_tokens={})
    for text, coded in zip(texts, bpe.Encoder(vocab).encode(texts), strict=True):
        ids = np.frombuffer(coded, "<u4")
        assert ids.tolist() == library.encode_ordinary(text)
        assert b"".join(vocab.decode(ids)) == text.encode()


def test_merge_replay_of_long_and_repeated_words(vocab):
    words = [b"a" * 3000, b"ab" * 700, b"the" * 500, b"", b"\xff\xfe"]
    for word, ids in zip(words, bpe.replay(words, vocab), strict=True):
        assert b"".join(vocab.bytes[i] for i in ids) == word
