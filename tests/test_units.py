from pyspark.sql import functions as F

from passagework.functions import text as X
from passagework.functions import vectors as V
from passagework.operators import chunk, postings, units

TEXTS = ["", None, " \n\t ", "Été ete ÉTÉ, l'eau claire l eau", "the the the cat", "İstanbul ΣΑΣ. ½ Ⅷ x² été", "no break a_b 日本語", "... !!! ---", "x the\nthe cat " * 7]
ASKED = [("ete",), ("the",), ("istanbul",), ("missing",), ("a",), ("eau",), ("l", "eau"), ("the", "the"), ("the", "the", "the"), ("cat", "x"), ("e", "te")]


def test_units_equal_postings_of_passages(spark):
    """Lengths, times, spellings and phrases of passages as postings have them, found in one pass that keeps no text."""
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "hash string, text string")
    made = units.units(rows, ASKED, 5, 2, True)
    assert "text" not in made.columns
    got = {(r["hash"], r.ordinal): (r.dl, {ASKED[h.t]: (h.tf, h.n) for h in r.hits}) for r in made.collect()}
    cut = chunk.chunk_words(rows, 5, 2)
    spread = cut.select("hash", "ordinal", X.tokens(F.col("text")).alias("tokens"), X.surfaces(F.col("text")).alias("surfaces")).collect()
    want = {}
    for r in spread:
        held = {}
        for a in ASKED:
            at = [i for i in range(len(r.tokens)) if tuple(r.tokens[i : i + len(a)]) == a]
            if at:
                held[a] = (len(at), len({r.surfaces[i] for i in at}) if len(a) == 1 else 1)
        want[r["hash"], r.ordinal] = (len(r.tokens), held)
    assert got == want
    assert {k: v[0] for k, v in got.items()} == {(r["hash"], r.ordinal): r.dl for r in postings.lengths(cut, ["hash", "ordinal"]).collect()}
    key = ["hash", "ordinal"]
    slow = V.with_word_vector(cut.select(*key, "text"), F.col("text")).select(*key, "embedding").orderBy(*key).collect()
    assert slow == V.vectors_of_counts(made, key).orderBy(*key).collect()


def test_words_are_read_again_after_a_reset():
    words = units._Words({"ete": 0, "the": 1}, True)
    first = [words[w] for w in (b"the", "Été,".encode(), b"the")]
    held, buckets = list(words.held), list(words.buckets)
    words.reset()
    assert first == [words[w] for w in (b"the", "Été,".encode(), b"the")] == [0, 1, 0]
    assert (held, buckets) == (list(words.held), list(words.buckets)) == ([1, 0, 0, 0, 0, 1], buckets)
    assert words.sizes.tolist() == [1, 1] and words[b"\xff\xfe"] == 2 and words.sizes[2] == 0
