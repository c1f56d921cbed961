"""Line dedup by an exact set-similarity join.

A line's set is its distinct words, lower-cased. A line goes if an earlier line, by doc_id and then line number, has a
set with a Jaccard similarity of 0.8 or more, whether or not that line goes as well. Lines without words stay.

Words are ordered by rarity: by how often words of their hash bucket come (``BUCKETS`` counts over the whole corpus, one
array that a scalar subquery reads, three levels to each doubling), then by hash. Of two similar sets let the smaller have n
words and the larger m. They share 4/9 of n + m at least, so one of these words is among the n // 9 + 1 rarest of the
smaller and the m // 5 + 1 rarest of the larger. Lists of lines that share such a word are joined under four bounds,
all exact: by length, by position, by order, and by parity (each word flips one of 64 bits, of 128 where both sets have
more than ``ONE_LANE`` words; sets that differ in few words differ in few bits). What passes is verified on the whole
sets.

Equal sets are one class, kept by its first line. Against large groups of near copies the join has two steps. First a
class meets only the first lines of the lists of a few of its rarest words, ``LEADERS`` at most in each; what that
removes needs no further answer. Then the rest meet their lists. No group is emitted as pairs or collected; all is DataFrame functions.

Nulls: a null text has no lines. A row without a doc_id comes after all others. Rows with the same doc_id and text
are judged as one. Extra columns are kept where whole documents are returned. An empty table gives no rows. A text is
split within its row, so a very long one takes some ten times its bytes in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

BUCKETS = 1 << 18
#: Words of a class that look for a first line in the first step: the rarest, and those of least hash among its n // 5
#: + 1 rarest, which edits that bring in new words don't push out.
FIRST_WORDS, ANY_WORDS = 1, 3
#: First lines of a list in the first step: one in each of so many shares of the list.
LEADERS = 24
#: Sets of more words have parities of 128 bits.
ONE_LANE = 72
#: Classes to verify are broadcast up to so many (a place of three numbers, some 100 bytes), else joined by a shuffle.
BROADCAST_CLASSES = 500_000
#: Parts of the last join's words, one after the other; each shuffles its share of the entries.
TURNS = 3
LAST = (1 << 63) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), text.alias("text")).select("d", F.xxhash64("text").alias("tag"), "text")


def _spaced(text: str) -> Column:
    """The column's text with spaces for white space other than line ends, where there is any."""
    odd = reduce(Column.__or__, [F.contains(F.col(text), F.lit(c)) for c in "\t\x0b\x0c\r"])
    return F.when(odd, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(F.col(text))


def rarity(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row, levels: a code's first byte of each hash bucket, by how often its words come, three to each doubling. A table,
    as a literal of this size would be spelt out in every plan, of which the driver keeps the descriptions."""
    text = docs.select(F.lower(F.col("text").cast("string")).alias("text")).select(_spaced("text").alias("text"))
    given = text.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1)).alias("w")).where("w <> ''")
    counts = given.groupBy(F.xxhash64("w").bitwiseAND(BUCKETS - 1).cast("int").alias("b")).count()
    level = F.least(F.lit(127), F.floor(3 * F.log2(F.col("count"))).cast("int"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    every = every.select("b", F.call_function("shiftleft", F.coalesce(level, F.lit(0)).cast("long"), F.lit(56)).alias("l"))
    return scratch.save(every.agg(F.sort_array(F.collect_list(F.struct("b", "l"))).alias("s")).select(F.col("s.l").alias("levels")), "levels")


def line_sets(docs: DataFrame, levels: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """d, tag, line_no, codes (the distinct words in their order, as sorted numbers), n, and the class's key k1, k2 of
    every line with a word; with ``wanted``, of its lines (d, tag, line_no) only."""

    def code(held: Column, h: Column) -> Column:
        level = F.coalesce(F.get(held, h.bitwiseAND(BUCKETS - 1).cast("int")), F.lit(0).cast("long"))
        return level.bitwiseOR(F.shiftrightunsigned(h, 8))

    rows = _keyed(docs)
    if wanted is not None:
        rows = rows.join(wanted.select("d", "tag").distinct(), ["d", "tag"], "left_semi")
    rows = rows.select("d", "tag", F.posexplode(F.split(_spaced("text"), "\n", -1)).alias("line_no", "line"))
    # a condition on codes would be pushed below and make them twice, and for lines that nobody wants
    rows = rows.where(F.trim("line") != "")
    if wanted is not None:
        rows = rows.join(wanted, ["d", "tag", "line_no"], "left_semi")
    # a lambda may not hold a subquery; as a column that is read once it is put in place and copied into no row
    rows = rows.withColumn("levels", levels.scalar())
    given = F.array(F.struct("levels", F.array_remove(F.split(F.lower("line"), " ", -1), "").alias("words")))
    codes = F.transform(given, lambda g: F.transform(F.transform(g["words"], lambda w: F.xxhash64(w)), lambda h: code(g["levels"], h)))[0]
    rows = rows.select("d", "tag", "line_no", F.sort_array(F.array_distinct(codes)).alias("codes"))
    return rows.withColumns({"n": F.size("codes"), "k1": F.xxhash64("codes"), "k2": F.xxhash64(F.lit(1), "codes")})


def _parity(codes: Column) -> Column:
    """Each word flips one of 64 bits."""
    one = F.lit(1).cast("long")
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(63).cast("int"))))


def _bounds() -> str:
    """Length, position and parity of two classes, all that similar sets allow, and that the later one is open.
    q: size, place and whether open, packed; p: parity of all words; o: parity of those of the second lane."""
    n, m, i, j = "shiftright(q, 33)", "shiftright(q_, 33)", "(shiftright(q, 1) & 4294967295)", "(shiftright(q_, 1) & 4294967295)"
    lanes = "bit_count((p ^ o) ^ (p_ ^ o_)) + bit_count(o ^ o_)"
    sizes = f"5 * least({n}, {m}) >= 4 * greatest({n}, {m}) and 9 * least({n} - {i}, {m} - {j}) >= 4 * ({n} + {m})"
    parity = f"9 * bit_count(p ^ p_) <= {n} + {m} and (least({n}, {m}) <= {ONE_LANE} or 9 * ({lanes}) <= {n} + {m})"
    return f"{sizes} and {parity} and ((d_ <= d and (q & 1) = 1) or (d <= d_ and (q_ & 1) = 1))"


def _entries(classes: DataFrame, words: Column) -> DataFrame:
    """code, x, d, p, o and q of ``words`` of each class; q holds a word's place in the array."""
    q = "shiftleft(cast(n as bigint), 33) | shiftleft(cast(i as bigint), 1) | cast(open as bigint)"
    # sets of three words or fewer are similar to none but their equals
    given = classes.where("n >= 4").select(F.posexplode(words).alias("i", "code"), F.col("k1").alias("x"), "n", "p", "o", F.col("first.d").alias("d"), "open")
    return given.select("code", "x", "d", "p", "o", F.expr(q).alias("q"))


def _rarest(words: str) -> Column:
    return F.slice("prefix", F.lit(1), F.expr(words))


def _other(entries: DataFrame) -> DataFrame:
    return entries.select("code", *[F.col(c).alias(f"{c}_") for c in ("x", "d", "p", "o", "q")])


def _small(table: DataFrame) -> DataFrame:
    """A written table, broadcast if it has ``BROADCAST_CLASSES`` rows or fewer."""
    return F.broadcast(table) if table.count() <= BROADCAST_CLASSES else table


def _sets(pairs: DataFrame, docs: DataFrame, levels: DataFrame, classes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """k1, k2, codes and first of the classes in ``pairs`` (x, y), a written table."""
    ids = scratch.save(pairs.select("x").union(pairs.select("y")).distinct().withColumnRenamed("x", "k1"), f"{name}_ids")
    named = scratch.save(classes.select("k1", "k2", "first").join(_small(ids), "k1", "left_semi"), f"{name}_named")
    places = scratch.save(named.select("first.*"), f"{name}_places")
    sets = line_sets(docs, levels, _small(places)).select("k1", "k2", "codes").dropDuplicates(["k1", "k2"])
    sets = scratch.save(sets.join(named, ["k1", "k2"]), f"{name}_sets")
    scratch.drop(f"{name}_ids", f"{name}_named", f"{name}_places")
    return sets


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """k1, k2 of the later classes of similar pairs."""
    x = sets.select(F.col("k1").alias("x"), "k2", "codes", "first")
    y = sets.select(*[F.col(c).alias("y" if c == "k1" else f"{c}_") for c in ("k1", "k2", "codes", "first")])
    found = pairs.join(x, "x").join(y, "y").where("9 * size(array_intersect(codes, codes_)) >= 4 * (size(codes) + size(codes_))")
    late = F.col("first_") < F.col("first")
    return found.select(F.when(late, F.col("x")).otherwise(F.col("y")).alias("k1"), F.when(late, F.col("k2")).otherwise(F.col("k2_")).alias("k2")).distinct()


def _led(entries: DataFrame) -> DataFrame:
    """Pairs (x, y) within the bounds of each entry and the first ones of its list, one in each share of the list."""
    share = F.pmod(F.xxhash64("x"), F.lit(LEADERS)).alias("share")
    first = entries.groupBy("code", share).agg(*[F.min_by(c, "d").alias(c) for c in ("x", "p", "o", "q")], F.min("d").alias("d"))
    return entries.join(_other(first), "code").where("x <> x_").where(_bounds()).select("x", F.col("x_").alias("y")).distinct()


def kept_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """d, tag and stay (line numbers) of every text of which a line with words stays (d is doc_id, or LAST where that is
    null): the first lines of the classes that have no similar earlier one."""
    levels = rarity(docs, scratch)
    second = F.when(F.col("n") > ONE_LANE, _parity(F.filter("codes", lambda x: x.bitwiseAND(64) != 0))).otherwise(F.lit(0).cast("long"))
    prefix = F.slice("codes", F.lit(1), F.expr("cast(n div 5 as int) + 1"))
    rows = line_sets(docs, levels).select("k1", "k2", F.struct("d", "tag", "line_no").alias("first"), "n", _parity(F.col("codes")).alias("p"), second.alias("o"), prefix.alias("prefix"))
    classes = rows.groupBy("k1", "k2").agg(F.min("first").alias("first"), *[F.first(c).alias(c) for c in ("n", "p", "o", "prefix")])
    classes = scratch.save(classes, "classes")

    # by their hashes alone, as a code's low bits are; the position bound holds for any place no later than the real one
    hashed = F.slice(F.sort_array(F.transform("prefix", lambda c: F.call_function("shiftleft", c, F.lit(8)))), 1, ANY_WORDS)
    some = F.array_distinct(F.concat(F.transform(_rarest(f"least({FIRST_WORDS}, size(prefix))"), lambda c: F.call_function("shiftleft", c, F.lit(8))), hashed))
    entries = _entries(classes.withColumn("open", F.lit(True)), some)
    entries = entries.withColumn("q", F.expr(f"q & ~{(1 << 33) - 2}"))
    star = scratch.save(_led(entries), "star")
    gone = scratch.save(_similar(star, _sets(star, docs, levels, classes, scratch, "star")), "gone")
    scratch.drop("star", "star_sets")

    # the words are joined in turns, by their hash, so that only a part of the entries is shuffled at a time
    known = classes.join(_small(gone).withColumn("open", F.lit(False)), ["k1", "k2"], "left").withColumn("open", F.coalesce("open", F.lit(True)))
    turns, order = [], "shiftright(q, 33) < shiftright(q_, 33) or (shiftright(q, 33) = shiftright(q_, 33) and x < x_)"
    for turn in range(TURNS):
        mine = F.pmod(F.col("code"), F.lit(TURNS)) == turn
        smaller, larger = (_entries(known, _rarest(f"cast(n div {part} as int) + 1")).where(mine) for part in (9, 5))
        both = smaller.join(_other(larger), "code").where(order).where(_bounds())
        turns.append(scratch.save(both.select("x", F.col("x_").alias("y")).distinct(), f"turn{turn}"))
    more = scratch.save(reduce(DataFrame.union, turns).distinct(), "rest")
    scratch.drop(*(f"turn{turn}" for turn in range(TURNS)))
    late = scratch.save(_similar(more, _sets(more, docs, levels, classes, scratch, "rest")), "gone_late")
    left = classes.select("k1", "k2", "first").join(_small(gone), ["k1", "k2"], "left_anti").join(_small(late), ["k1", "k2"], "left_anti")
    out = scratch.save(left.groupBy("first.d", "first.tag").agg(F.sort_array(F.collect_list("first.line_no")).alias("stay")), "stay")
    scratch.drop("classes", "rest", "rest_sets", "gone", "gone_late", "levels")
    return out


def _with_removed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The columns of ``docs`` as c0, c1 ..., the text t, n_lines, and the numbers of the lines with a word that don't
    stay."""
    kept = kept_lines(docs, scratch)
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), text.alias("t"))
    joined = keyed.withColumn("tag", F.xxhash64("t")).join(_small(kept), ["d", "tag"], "left")
    split = joined.withColumn("_lines", F.split(_spaced("t"), "\n", -1))
    worded = F.filter(F.transform("_lines", lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    removed = F.array_except(worded, F.coalesce("stay", F.array().cast("array<int>")))
    return split.select(*[f"c{i}" for i in range(len(columns))], "t", F.size("_lines").alias("n_lines"), removed.alias("removed"))


def report(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_lines, n_removed and removed_lines (sorted line numbers from 0) of each row."""
    rows = _with_removed(docs.select("doc_id", "text"), scratch)
    return rows.select(F.col("c0").cast("long").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.col("removed").alias("removed_lines"))


def without_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with the lines that stay; n_chars, where there is one, is that of the new text."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = _with_removed(docs, scratch)
    whole = F.size("removed") == 0
    # array_except hashes the line numbers, so a long text with many repeats takes linear time
    rows = rows.withColumn("lines", F.when(~whole, F.split("t", "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("removed"))
    out = rows.withColumn(at["text"], F.when(whole, F.col(at["text"])).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")))
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.when(whole, F.col(at["n_chars"])).otherwise(F.char_length(at["text"]).cast("long")))
    return out.select(*[F.col(a).alias(c) for c, a in at.items()])
