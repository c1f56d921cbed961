"""Every operator on odd rows, on an empty table, and against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from passagework.llm import bayes, bpe, chains, decontaminate, jaccard, lines, quality, shards, substrings, warc
from passagework.llm.scratch import Scratch

from .cases import BASE, LONG, TEXTS, empty, odd, prose


@pytest.fixture()
def scratch(spark):
    return Scratch(spark)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


# 1


def test_leaks(spark, scratch):
    items = [(1, prose(50, 30)), (2, prose(51, 40)), (3, None), (4, ""), (5, "short item here"), (None, prose(52, 25)), (2, prose(51, 40))]
    bench = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, score string")
    upper = prose(51, 40).upper().replace(" ", "\n")
    docs = odd(spark).select("doc_id", "text", "kept").union(spark.createDataFrame([(20, prose(60, 300) + " " + prose(50, 30) + " " + prose(61, 300), "x"), (21, upper, "x"), (22, " ".join(prose(50, 30).split()[:15]), "x"), (23, "short item here", "x"), (24, prose(52, 25), "x")], "doc_id long, text string, kept string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(20, 1), (21, 2), (23, 5), (24, None)}
    kept = {r.doc_id for r in decontaminate.drop_leaking(docs, bench, scratch).collect()}
    assert kept == {i for i, _ in TEXTS} | {22}
    assert decontaminate.leaks(empty(spark), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_wand_finds_what_full_scoring_finds():
    import numpy as np

    items = [(i, prose(100 + i, 12 + i % 30), None) for i in range(200)]
    rows, stats = decontaminate.parse_items(items), decontaminate.no_stats()
    stats.add(rows)
    index = decontaminate.build_index(rows, stats)
    r = np.random.default_rng(1)
    for _ in range(40):
        terms = np.sort(r.choice(len(index.terms), 60, replace=False))
        score = np.zeros(len(index.ids))
        for t in terms:
            s = slice(index.first[t], index.first[t + 1])
            score[index.items[s]] += index.impacts[s]
        for threshold in (0.05, 0.2, 0.4):
            found = decontaminate.wand(index, terms.tolist(), threshold, list(range(-(-len(items) // decontaminate.BLOCK))))
            assert {i for i, _ in found} == set(np.flatnonzero(score >= threshold * (1 - 1e-9)).tolist())


def full_bm25(docs, items):
    """Leaks by scoring every passage against every item in full."""
    import math

    own = {i: bare(t or "") for i, t in items}
    own = {i: w for i, w in own.items() if w}
    df = Counter(x for w in own.values() for x in set(w))
    mean = sum(map(len, own.values())) / len(own)
    stride = max(64, *map(len, own.values()))
    k1, b = 1.2, 0.75

    def impacts(w):
        return {x: math.log1p((len(own) - df[x] + 0.5) / (df[x] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * len(w) / mean)) for x, n in Counter(w).items()}

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    table = {i: impacts(w) for i, w in own.items()}
    out = {}
    for d, t in docs:
        w = bare(t or "")
        starts = [0] + [s for s in range(stride, len(w), stride) if s + stride < len(w)]
        for s in starts:
            passage = w[s : s + 2 * stride]
            has, sh = set(passage), shingles(passage)
            for i, worth in table.items():
                score = sum(v for x, v in worth.items() if x in has) / sum(worth.values())
                cut = len(own[i]) - max(5, len(own[i]) // 4) if len(own[i]) >= 10 else len(own[i])
                parts = [shingles(own[i][:cut]), shingles(own[i][cut:])]
                if score >= 0.7 and all(len(p & sh) >= 0.8 * len(p) for p in parts):
                    out[d, i] = max(out.get((d, i), 0), round(score, 6))
    return out


@pytest.mark.parametrize("most", [decontaminate.MAX_ITEM_WORDS, 100])
def test_leaks_are_those_of_full_scoring(spark, monkeypatch, most):
    import random

    monkeypatch.setattr(decontaminate, "MAX_ITEM_WORDS", most)
    r = random.Random(21)
    items = [(i, prose(800 + i, r.randint(8, 45))) for i in range(40)]
    docs = []
    for d in range(120):
        parts = [prose(900 + d, r.randint(5, 260))]
        if d % 2:
            w = r.choice(items)[1].split()
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = "other"
            parts.insert(r.randint(0, 1), " ".join(w))
        docs.append((d, " ".join(parts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).collect()}
    want = full_bm25(docs, items)
    assert got.keys() == want.keys() and len(want) > 25
    assert all(abs(got[x] - want[x]) < 2e-6 for x in want)


# 2


def test_chain_is_the_best_by_brute_force():
    import itertools
    import random

    r = random.Random(2)
    for _ in range(60):
        m = sorted({(r.randint(0, 30), r.randint(0, 30)) for _ in range(7)})
        pos, src = [p for p, _ in m], [s for _, s in m]

        def worth(c, pos=pos, src=src):
            cost = sum(chains.GAP * (pos[b] + src[b] - pos[a] - src[a]) + chains.SHIFT * (pos[b] - src[b] != pos[a] - src[a]) for a, b in itertools.pairwise(c))
            return chains.K * len(c) - cost

        found = chains.chain(pos, src)
        assert sorted(x for c in found for x in c) == list(range(len(pos)))
        for c in found:
            assert all(pos[a] < pos[b] and src[a] < src[b] for a, b in itertools.pairwise(c))
        best = max(worth(c) for n in range(1, len(pos) + 1) for c in itertools.combinations(range(len(pos)), n) if all(pos[a] < pos[b] and src[a] < src[b] for a, b in itertools.pairwise(c)))
        assert worth(found[0]) >= best - chains.SHIFT * len(pos)


def test_repeated_passages(spark, scratch):
    shared = prose(70, 80)
    edited = shared.split()
    edited[30] = "changed"
    del edited[55]
    docs = odd(spark).select("doc_id", "text").union(spark.createDataFrame([(30, prose(71, 200) + " " + shared), (31, prose(72, 90) + " " + shared.upper() + " " + prose(73, 50)), (32, " ".join(edited)), (33, " ".join(shared.split()[:30]))], "doc_id long, text string"))
    got = defaultdict(list)
    for r in chains.repeated_passages(docs, scratch).collect():
        got[r.doc_id].append(r)
    assert {31, 32, 7, 8, 10} <= set(got) and not {3, 30, 33, 14, 11, 12} & set(got)
    assert any(r.source_doc_id == 30 and r.begin_word == 90 and r.end_word == 170 and r.matches == 80 for r in got[31])
    assert any(r.source_doc_id == 30 and r.matches >= 70 for r in got[32])
    assert chains.repeated_passages(empty(spark), Scratch(spark)).count() == 0


def bare(text):
    return re.findall(r"[^\x00-\x2f:-@\[-`{-\x7f]+", text.lower())


def test_every_repeat_of_fifty_words_is_in_a_passage(spark, scratch):
    import random

    r = random.Random(12)
    pool = [prose(600 + i, 40) for i in range(8)]
    rows = [(1, prose(620, 70) + " " + pool[0]), (2, prose(621, 70) + " " + pool[1])]
    rows += [(i, " ".join([prose(630 + i, 30), pool[0], pool[1], prose(640 + i, 30)])) for i in (6, 7)]
    # the source holds the start of the repeat once more before it
    rows += [(8, " ".join([pool[2][:150], prose(650, 60), pool[2], pool[3]])), (9, " ".join([prose(651, 40), pool[2], pool[3]]))]
    rows += [(20 + i, " ".join(x for _ in range(3) for x in (prose(700 + 3 * i + _, r.randint(1, 30)), *r.sample(pool, r.randint(1, 3))))) for i in range(40)]
    got = defaultdict(list)
    for x in chains.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch).collect():
        assert x.source_doc_id < x.doc_id and x.matches >= 0.8 * max(x.end_word - x.begin_word, x.source_end_word - x.source_begin_word)
        got[x.doc_id].append(x)
    first, wanted = {}, 0
    for i, t in sorted(rows):
        w = bare(t)
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p : p + 50]), i) < i:
                wanted += 1
                assert any(x.begin_word <= p and p + 50 <= x.end_word for x in got[i]), (i, p)
    assert wanted > 500
    assert any(x.source_doc_id == 6 and x.end_word - x.begin_word >= 80 for x in got[7])


def test_near_passages_are_found(spark, scratch):
    import random

    r, rows, wanted = random.Random(13), [], {}

    def own(n):
        return [f"p{r.randrange(10**9)}" for _ in range(n)]

    for n in (50, 60, 80, 120):
        cases = [range(e - 1, n, e) for e in (5, 6, 7, 10, 20)] + [r.sample(range(n), n * percent // 100) for percent in (5, 10, 15, 20)]
        for changed in cases * 3:
            words_ = [f"v{r.randrange(3000)}" for _ in range(n)]
            copy = [f"z{r.randrange(10**9)}" if j in changed else w for j, w in enumerate(words_)]
            i = len(rows)
            rows += [(i, " ".join(own(40) + words_ + own(40))), (i + 1, " ".join(own(40) + copy + own(40)))]
            wanted[i + 1] = n - len(changed)
    got = {}
    for x in chains.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch).collect():
        if x.source_doc_id == x.doc_id - 1:
            got[x.doc_id] = max(got.get(x.doc_id, 0), x.matches)
    assert set(got) == set(wanted)
    assert all(got[i] >= 0.8 * wanted[i] for i in wanted)


# 3


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        sets.setdefault(i, set()).update([tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies():
    """A group of near copies of one text, pairs of others, and a passage that many share."""
    import random

    r, rows, base = random.Random(9), [], prose(80, 120).split()
    for i in range(120):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = f"e{r.randrange(1000)}"
        rows.append((100 + i, " ".join(w)))
    passage = prose(81, 60)
    for i in range(60):
        rows.append((300 + i, passage + " " + prose(400 + i, r.choice([2, 5, 9, 30]))))
    for i in range(40):
        rows.append((400 + i, prose(500 + i // 2, 50) + (" x" if i % 2 else "")))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_components(spark, scratch, monkeypatch, k, percent):
    monkeypatch.setattr(jaccard, "HOT_LEAST", 16)
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch, k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_components_of_odd_rows(spark, scratch):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(odd(spark), scratch).collect()), key=str)
    want = brute_components([(i, t) for i, t in TEXTS if i is not None], 4, 85)
    assert [g for g in got if g[0] is not None] == sorted(((i, *want[i]) for i, _ in TEXTS if i is not None), key=str)
    assert all(g[2] is None for g in got if g[0] is None)
    kept = [r.doc_id for r in jaccard.keep_one(odd(spark), Scratch(spark), 5, 80).collect()]
    assert 7 not in kept and 12 not in kept and 3 in kept and kept.count(None) == 2
    assert jaccard.link(empty(spark), Scratch(spark)).count() == 0


# 4


def brute_lines(rows):
    seen, out = [], defaultdict(list)
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            w = frozenset(x.lower() for x in words(line))
            if w:
                if any(5 * len(w & v) >= 4 * len(w | v) for v in seen):
                    out[i].append(k)
                seen.append(w)
    return out


def test_lines(spark, scratch):
    import random

    r, rows, base = random.Random(4), [], [prose(200 + i, 14).replace("\n", "") for i in range(12)]
    for i in range(150):
        some = []
        for _ in range(r.randint(0, 4)):
            w = r.choice(base).split()
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = f"e{r.randrange(500)}"
            some.append(" ".join(w[: r.choice([3, 4, 5, 14])]))
        rows.append((i, "\n".join(some)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.removed_lines for x in lines.report(docs, scratch).collect()}
    want = brute_lines(rows)
    assert got == {i: want.get(i, []) for i, _ in rows}


def test_lines_that_share_a_rare_word_only(spark, scratch):
    rows = [(i, f"sharedword {prose(5000 + i, 12)}".replace("\n", " ")) for i in range(3000)] + [(5000 + i, f"sharedword {prose(5000 + i, 12)}".replace("\n", "  ").upper()) for i in range(40)]
    got = {x.doc_id: x.removed_lines for x in lines.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), scratch).collect()}
    assert all(got[5000 + i] == [0] for i in range(40)) and sum(len(v) for v in got.values()) == 40


def test_plans_of_lines_stay_short(spark):
    """The driver keeps a description of every plan, so the rarity of all buckets is read and not spelt out in them."""
    sizes = []

    class Spy(Scratch):
        def save(self, df, name, *more):
            sizes.append(len(df._jdf.queryExecution().toString()))
            return super().save(df, name, *more)

    lines.report(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string"), Spy(spark)).collect()
    assert 5 < len(sizes) and max(sizes) < lines.BUCKETS


def test_lines_of_odd_rows(spark, scratch):
    out = lines.without_repeats(odd(spark), scratch)
    assert out.columns == odd(spark).columns and out.count() == len(TEXTS)
    got = {(r.doc_id, r.text) for r in out.collect()}
    want = brute_lines(TEXTS)
    for i, t in TEXTS:
        if i is not None:
            assert (i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])) in got
    assert {r._d for r in out.collect()} == {"extra"}
    assert lines.report(empty(spark), Scratch(spark)).count() == 0


# 5


def brute_counts(text):
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    filled = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(filled) - len(set(filled)), len(covered)


def test_quality(spark, scratch):
    more = [(40, "a b c " * 30), (41, "a b c d a b c x y a b c\n\na b\na b"), (42, "#*$%&|<> é日 x"), (43, prose(90, 70))]
    docs = odd(spark).select("doc_id", "text", "source", "n_words", "kept").union(spark.createDataFrame([(i, t, "s1", "e", "e") for i, t in more], "doc_id long, text string, source string, n_words string, kept string"))
    judged = quality.judge(docs, scratch).collect()
    for r in judged:
        options = [t for i, t in TEXTS + more if i == r.doc_id]
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert own in [brute_counts(t) for t in options]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.host_failed)
    kept = quality.keep_good(docs, Scratch(spark))
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in judged if r.kept)
    assert 43 in {r.doc_id for r in judged if not r.base_failed}
    assert quality.judge(empty(spark), Scratch(spark)).count() == 0


def test_repeats_of_long_texts(spark, monkeypatch):
    import random

    r = random.Random(31)
    texts = [" ".join(f"w{r.randrange(int(n ** 0.5) + 2)}" for _ in range(n)) for n in (0, 1, 2, 3, 50, 3_000)]
    texts.append(" ".join(f"w{r.randrange(4_000)}" for _ in range(400_000)))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: brute_counts(t) for i, t in enumerate(texts)}
    for least in (quality.LONG_TEXT, 2):
        monkeypatch.setattr(quality, "LONG_TEXT", least)
        some = rows if least > 2 else rows.where("doc_id < 6")
        got = {x.doc_id: tuple(x[c] for c in quality.COUNTS) for x in quality.with_counts(some).collect()}
        assert got == {i: want[i] for i in got} and len(got) == (7 if least > 2 else 6)


def test_hosts_are_shrunk(spark):
    rows = [(h, i < bad) for h, n, bad in (("good", 400, 8), ("bad", 300, 290), ("few", 1, 1)) for i in range(n)]
    got = {r["_host"]: r for r in quality.host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean")).collect()}
    assert got["bad"].host_failed and not got["good"].host_failed
    assert got["few"].rate < 1 and got["good"].rate > 8 / 400


# 6


def test_bpe(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.encode_texts(odd(spark), path, tokenizers.PATTERN, keep_ids=True).collect()
    assert len(got) == len(TEXTS) and all(r.slot == "extra" for r in got)
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in TEXTS)
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert bpe.encode_texts(empty(spark), path, tokenizers.PATTERN).count() == 0


# 7


def brute_removed(rows, size=50):
    first = {}
    body = {i: (t or "").encode() for i, t in rows}
    for i in sorted(body):
        for s in range(len(body[i]) - size + 1):
            first.setdefault(body[i][s : s + size], i)
    out = {}
    for i, b in body.items():
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < i:
                gone[s : s + size] = b"\1" * size
        spans = len([0 for s in range(len(b)) if gone[s] and (s == 0 or not gone[s - 1])])
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_removed_bytes(spark, scratch, hot):
    import random

    r, rows = random.Random(8), []
    pool = [prose(300 + i, 40) for i in range(6)] + ["ab" * 60, "é日本" * 30]
    for i in range(120):
        parts = [x[r.randrange(0, 30) : r.randrange(40, len(x))] if r.random() < 0.7 else x for x in r.sample(pool, r.randint(0, 3))]
        rows.append((i * 3, r.choice(["", "q", prose(900 + i, 20)]).join(parts)))
    rows.append((1000, rows[5][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substrings.remove_repeats(docs, scratch, hot=hot).collect()}
    assert got == brute_removed(rows)


def test_removed_bytes_of_odd_rows(spark, scratch):
    got = substrings.remove_repeats(odd(spark), scratch, keep_text=True).collect()
    assert len(got) == len(TEXTS)
    want = brute_removed([(i, t) for i, t in TEXTS if i is not None])
    for r in got:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert substrings.remove_repeats(empty(spark), Scratch(spark)).count() == 0


# 8


def test_shards(spark, scratch):
    docs = odd(spark).select("doc_id", "text", "slot").union(spark.createDataFrame([(i, f"t{i}", "e") for i in range(100, 3100)], "doc_id long, text string, slot string"))
    got = shards.shard(docs, scratch).collect()
    assert len(got) == len(TEXTS) + 3000
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert set(by) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    moved = sum(r.grown_shard == 24 for r in got)
    assert 60 <= moved <= 190 and all(70 <= len(s) <= 190 for s in by.values())
    texts = dict(t for t in TEXTS if t[0] is not None)
    for r in got:
        if r.doc_id in texts:
            body = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(body) + 8, zlib.crc32(body))
    assert shards.shard(empty(spark), Scratch(spark)).count() == 0


def drawn(key, tree):
    """Shard of a key by hashing anew in Python."""
    import math

    names = [f"/{r}/{k}/{s}" for r, racks in tree.items() for k, own in racks.items() for s in own]

    def weight(node):
        return node if isinstance(node, float) else sum(map(weight, node.values()))

    path, node = "", tree
    while not isinstance(node, float):
        def worth(x, path=path):
            i, name, child = x
            digits = int(hashlib.md5(f"{key}|{path}/{name}".encode()).hexdigest()[:13], 16)
            return math.log((digits + 0.5) / 2.0**52) / weight(child), -i

        _, name, node = max(((i, n, c) for i, (n, c) in enumerate(node.items())), key=worth) if len(node) > 1 else (0, *next(iter(node.items())))
        path += f"/{name}"
    return names.index(path)


def test_shards_are_those_of_the_draws(spark, scratch):
    rows = [(i, f"t{i % 50}") for i in range(500)] + [(None, "without"), (-3, None)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    tree = shards.uniform_tree()
    for r in got:
        key = str(r.doc_id) if r.doc_id is not None else f"crc{r.text_crc32}"
        assert (r.shard, r.grown_shard) == (drawn(key, tree), drawn(key, shards.grow(tree)))


def test_changed_weights_move_rows_only_into_or_out_of_their_subtree(spark):
    from pyspark.sql import functions as F

    old = {"a": {"x": {"0": 1.0, "1": 1.0}, "y": {"0": 1.0}}, "b": {"x": {"0": 2.0}}}
    new = {"a": {"x": {"0": 1.0, "1": 1.0}, "y": {"0": 3.0}}, "b": {"x": {"0": 2.0}}}
    key = F.col("id").cast("string")
    rows = spark.range(4000).select(shards.descend(key, old).alias("o"), shards.descend(key, new).alias("n"))
    moves = {(r.o, r.n) for r in rows.distinct().collect() if r.o != r.n}
    # more weight below a: rows come into a, from b, and within a into y; nothing leaves y or goes to b
    assert moves and all(n != 3 and o != 2 for o, n in moves)


# 9


def test_warc(spark, scratch):
    big = "<p>" + "payload " * 60_000
    rows = [(5, "http://a/1", big), (3, "http://a/2\r\nx", big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (None, "u", big), (7, "é", "é" * 60), (8, "é", "é" * 60), (8, "é", "é" * 60)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    chunks = warc.write_archives(pages, scratch, chunk=1000)
    assert chunks.where("octet_length(data) > 1500").count() == 0
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(chunks).collect()), key=str)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = i is not None and h in first and first[h] < i
        want.append((i, "revisit" if again else "response", first[h] if again else None, len(body), hashlib.sha256(body).hexdigest()))
    assert got == sorted(want, key=str)
    assert warc.pages_to_warc(pages.limit(0), Scratch(spark)).count() == 0


def test_a_lost_chunk_is_found(spark, scratch):
    pages = spark.createDataFrame([(1, "u", "x" * 5000)], "page_id long, url string, html string")
    chunks = warc.write_archives(pages, scratch, chunk=1000)
    with pytest.raises(Exception, match="missing, repeated or damaged"):
        warc.read_archives(chunks.where("chunk_no <> 2")).collect()


# 10


def test_classifier(spark, scratch):
    import random

    r, rows, labels = random.Random(6), [], []
    for i in range(600):
        bad, low = i % 5 == 0, i % 7 == 0
        text = prose(2000 + i, 80)
        if bad:
            text = " ".join(w if r.random() > 0.05 else r.choice(["vile", "nasty"]) for w in text.split()) + " vile"
        if low:
            text = "%%% ".join(text.split()) + " ###"
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        if i < 400:
            labels.append((i, int(not low), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in bayes.classify(docs, marks, scratch).collect()}
    held = range(400, 600)
    assert sum((got[i].toxic >= 0.5) == (i % 5 == 0) for i in held) >= 196
    assert sum((got[i].quality < 0.5) == (i % 7 == 0) for i in held) >= 196
    assert all(got[i].kept == (got[i].toxic < 0.5 and got[i].quality >= 0.5) for i in held)
    assert bayes.classify(odd(spark), marks.limit(0), Scratch(spark)).count() == len(TEXTS)
    assert bayes.classify(empty(spark), marks, Scratch(spark)).count() == 0
    assert LONG and BASE


def test_posteriors_are_those_of_the_formula(spark, scratch):
    import math
    import random

    r = random.Random(41)
    rows = [(i, f"h{i % 5 if i % 3 else 0}", f"p{r.randrange(3)}", r.gauss(-1, 2), r.gauss(-3, 2)) for i in range(300)] + [(300, "alone", "p", 0.5, -2.0)]
    labels = [(i, r.randrange(2), int(i % 15 == 0)) for i in range(0, 300, 4)] + [(0, 1, 1), (None, 1, 1), (999, 0, 0)]
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, low double, toxic double")
    given = bayes.with_labels(scored, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), scratch)
    got = {x.doc_id: x for x in bayes.judge(given, bayes.site_sums(given)).collect()}
    assert len(got) == len(rows)
    for t, column in ((1, "quality"), (2, "toxic")):
        own = defaultdict(list)
        for x in labels:
            own[x[0]].append(1 - x[1] if t == 1 else x[2])
        y = {i: sum(own[i]) / len(own[i]) if i in own else 1 / (1 + math.exp(-row[2 + t])) for i, row in enumerate(rows)}
        g = sum(y.values()) / len(y)

        def prior(sites, above, y=y):
            n = sum(map(len, sites.values()))
            rate = {k: sum(y[i] for i in m) / len(m) for k, m in sites.items()}
            spread = sum(len(m) * (rate[k] - above[k]) ** 2 for k, m in sites.items()) / n
            return max(1, min(1e6, sum(len(m) * above[k] * (1 - above[k]) for k, m in sites.items()) / n / spread - 1))

        hosts, paths = defaultdict(list), defaultdict(list)
        for i, row in enumerate(rows):
            hosts[row[1]].append(i)
            paths[row[1], row[2]].append(i)
        sh = prior(hosts, {k: g for k in hosts})
        mean = {k: (sum(y[i] for i in m) + g * sh) / (len(m) + sh) for k, m in hosts.items()}
        sp = prior(paths, {k: mean[k[0]] for k in paths})
        odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
        for i, row in enumerate(rows):
            h = (sum(y[j] for j in hosts[row[1]] if j != i) + g * sh) / (len(hosts[row[1]]) - 1 + sh)
            m = paths[row[1], row[2]]
            p = 1 / (1 + math.exp(-(row[2 + t] + odds((sum(y[j] for j in m if j != i) + h * sp) / (len(m) - 1 + sp)) - odds(g))))
            assert abs(got[i][column] - (1 - p if t == 1 else p)) < 2e-6
