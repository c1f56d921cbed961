"""Keyword search of many queries at once: BM25 over words and adjacent phrases.

Queries are a table (query_id, query). Each word or quoted phrase is a term of one or more index tokens which must be
adjacent and in order. The terms are few and known in size; they are joined to the postings, whose term column
prunes them, and all ranking is by grouped aggregation and per-query windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import BM25_B, BM25_K1, COMMON_SHARE, IDF_FLOOR, SNIPPET_WORDS
from . import rank


def parse(queries: DataFrame) -> DataFrame:
    """query_id, kind (phrase or word), no (from 0, phrases first) and text of each term."""
    split = queries.select("query_id", X.query_phrases(F.col("query")).alias("p"), X.query_words(F.col("query")).alias("w"))
    both = F.concat(F.transform("p", lambda t: F.struct(F.lit("phrase").alias("kind"), t.alias("text"))), F.transform("w", lambda t: F.struct(F.lit("word").alias("kind"), t.alias("text"))))
    return split.select("query_id", F.posexplode(both).alias("no", "t")).select("query_id", "t.kind", F.col("no").cast("long").alias("no"), "t.text")


def uncommon(terms: DataFrame, df: DataFrame, stats: DataFrame, share: float = COMMON_SHARE) -> DataFrame:
    """The terms without words in more than ``share`` of all units (and more than one). Where all of a query's words
    are that common, the rarest stays. Phrases stay. A word is looked up as written, in lower case."""
    keyed = terms.withColumn("_key", X.trimmed(F.lower("text")))
    known = keyed.join(df.select(F.col("term").alias("_key"), "doc"), "_key", "left").join(F.broadcast(stats.select("n_units")))
    known = known.withColumns({"doc": F.coalesce("doc", F.lit(0)), "_word": F.col("kind") == "word"})
    known = known.withColumn("_few", F.col("doc") <= F.greatest(F.col("n_units") * share, F.lit(1.0)))
    own = W.partitionBy("query_id")
    ranked = known.withColumns({"_any": F.max(F.col("_few") & F.col("_word")).over(own), "_place": F.row_number().over(W.partitionBy("query_id", "_word").orderBy("doc", "no"))})
    keep = ~F.col("_word") | F.col("_few") | (~F.col("_any") & (F.col("_place") == 1))
    return ranked.where(keep).select("query_id", "kind", "no", "text", "doc")


def wanted_terms(terms: DataFrame) -> DataFrame:
    """term: the index tokens that ``uncommon`` and ``matches`` look up for ``terms``."""
    looked_up = F.concat(X.tokens(F.col("text")), F.array(X.trimmed(F.lower("text"))))
    return terms.select(F.explode(looked_up).alias("term")).distinct()


def matches(terms: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """query_id, no, kind, key, tf and surfaces (distinct spellings) of each term in each unit that holds it."""
    split = terms.select("query_id", "kind", "no", X.tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    single = split.where(F.size("tokens") == 1).select("query_id", "kind", "no", F.col("tokens")[0].alias("term"))
    one = index.join(F.broadcast(single), "term").groupBy("query_id", "kind", "no", *key).agg(F.sum("tf").alias("tf"), F.collect_set("surface").alias("surfaces"))
    # a phrase is looked for where its rarest token stands: each other token must be at its place from there
    term = ["query_id", "kind", "no"]
    several = split.where(F.size("tokens") > 1).select(*term, F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "term"))
    counts = index.join(F.broadcast(several.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("tf").alias("_c"))
    placed = several.join(counts, "term", "left").withColumn("_nth", F.row_number().over(W.partitionBy(*term).orderBy(F.coalesce("_c", F.lit(0)), "at")))
    rarest, rest = placed.where("_nth = 1").select(*term, "n", "at", "term"), placed.where("_nth > 1").select(*term, "at", "term")
    starts = index.join(F.broadcast(rarest), "term").select(*term, "n", *key, "at", F.explode("positions").alias("pos")).select(*term, "n", *key, (F.col("pos") - F.col("at")).alias("start"))
    others = index.join(F.broadcast(rest.select("term").distinct()), "term", "left_semi").select(*key, "term", "positions")
    asked = starts.where("start >= 0").join(F.broadcast(rest), term).join(others, [*key, "term"]).where(F.array_contains("positions", F.col("start") + F.col("at")))
    whole = asked.groupBy(*term, "n", *key, "start").agg(F.count("*").alias("c")).where("c = n - 1")
    many = whole.groupBy("query_id", "kind", "no", *key).agg(F.count("*").alias("tf"), F.array(F.concat(F.lit("\0"), F.col("no").cast("string"))).alias("surfaces"))
    return one.unionByName(many)


def idf(n: Column, holding: Column) -> Column:
    raw = F.ln((n - holding + 0.5) / (holding + 0.5))
    return F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)


def bm25(found: DataFrame, doc_lengths: DataFrame, stats: DataFrame, key: list[str], spellings: bool = False) -> DataFrame:
    """query_id, key, score and phrases (that stand in it) of each unit that holds a term of the query; with
    ``spellings``, matched (distinct spellings) as well."""
    holding = found.groupBy("query_id", "no").agg(F.count("*").alias("holding"))
    rows = found.join(F.broadcast(holding), ["query_id", "no"]).join(doc_lengths, key).join(F.broadcast(stats))
    matched = [F.size(F.array_distinct(F.flatten(F.collect_list("surfaces")))).cast("long").alias("matched")] if spellings else []
    weight = idf(F.col("n_units"), F.col("holding")) * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    grouped = rows.groupBy("query_id", *key).agg(F.sum(weight).alias("score"), F.count_if(F.col("kind") == "phrase").alias("phrases"), *matched)
    return grouped.withColumn("score", F.round("score", 6))


def with_matched(best: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """``best`` (query_id, key, ...), a few rows of each query, with matched: distinct spellings of the query's terms."""
    own = ["query_id", *key]
    spelt = found.join(best.select(*own), own, "left_semi").groupBy(*own).agg(F.size(F.array_distinct(F.flatten(F.collect_list("surfaces")))).cast("long").alias("matched"))
    return best.join(spelt, own)


def top(rows: DataFrame, key: list[str], limit: int, score: str = "score") -> DataFrame:
    """The best ``limit`` of each query, ranked from 1; ties by key."""
    order = W.partitionBy("query_id").orderBy(F.desc(score), *key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def search(queries: DataFrame, index: DataFrame, doc_lengths: DataFrame, df: DataFrame, stats: DataFrame, key: list[str], limit: int, keep: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """query_id, rank, key, score and matched. Every phrase must stand in the unit; without phrases half of the words
    left must. Half is asked of the best ``5 * limit + 20``. ``keep`` may write the matches, which are read three times."""
    terms = uncommon(parse(queries), df, stats)
    needs = terms.groupBy("query_id").agg(F.count_if(F.col("kind") == "phrase").alias("n_phrases"), F.count_if(F.col("kind") == "word").alias("n_words"))
    found = keep(matches(terms, index, key))
    scored = bm25(found, doc_lengths, stats, key).join(F.broadcast(needs), "query_id")
    best = with_matched(top(scored.where("phrases = n_phrases"), key, 5 * limit + 20).drop("rank"), found, key)
    enough = (F.col("n_phrases") > 0) | (F.col("matched") >= F.ceil(F.col("n_words") / 2))
    return top(best.where(enough), key, limit).select("query_id", F.col("rank").cast("long").alias("rank"), *key, "score", "matched")


def asked_terms(terms: DataFrame) -> tuple[list[Row], list[tuple[str, ...]]]:
    """``terms`` with their tokens and the word that ``uncommon`` looks up (query_id, kind, no, tokens, looked_up), and
    the distinct terms of them, each its tokens."""
    rows = terms.select("query_id", "kind", "no", X.tokens(F.col("text")).alias("tokens"), X.trimmed(F.lower("text")).alias("looked_up")).collect()
    forms = {tuple(r.tokens) for r in rows} | {(r.looked_up,) for r in rows}
    return rows, sorted(f for f in forms if f and all(f))


class Units:
    """Matches of the terms ``rows`` (of ``asked_terms``, few and known) in units (key, dl, hits: t, tf and n, as
    ``units.units`` gives for ``asked``). ``df`` (term, doc, cnt) has the terms of one token."""

    def __init__(self, rows: list[Row], asked: list[tuple[str, ...]], units: DataFrame, key: list[str], share: float = COMMON_SHARE):
        self.units, self.key, self.asked, self.share = units, key, asked, share
        self.of = rank.totals(units, len(asked))
        self.number = {a: i for i, a in enumerate(asked)}
        self.doc_of = {a: int(n) for a, n in zip(asked, self.of.doc, strict=True)}
        by_query: dict[int, list[Row]] = {}
        for r in sorted((r for r in rows if r.query_id is not None), key=lambda r: (r.query_id, r.no)):
            by_query.setdefault(r.query_id, []).append(r)
        self.queries = [self._query(query_id, *self.kept(own)) for query_id, own in by_query.items()]

    def kept(self, rows: list[Row]) -> tuple[list[Row], int]:
        """Those of a query's terms that are searched, as ``uncommon`` has it, and how many spellings are needed."""
        doc = [self.doc_of.get((r.looked_up,), 0) for r in rows]
        words = [i for i, r in enumerate(rows) if r.kind == "word"]
        few = [i for i in words if doc[i] <= max(self.of.n_units * self.share, 1.0)]
        left = few or sorted(words, key=lambda i: (doc[i], rows[i].no))[:1]
        return [r for i, r in enumerate(rows) if r.kind != "word" or i in left], -(-len(left) // 2)

    def _query(self, query_id: int, kept: list[Row], needed: int) -> rank.Query:
        query, seen = rank.Query(query_id, n_phrases=sum(r.kind == "phrase" for r in kept), needed=needed), set()
        for r in kept:
            t = self.number.get(tuple(r.tokens))
            if t is not None:
                # a token's spellings count once for a query, however many of its terms are that token
                query.terms.append((t, r.kind == "phrase", len(r.tokens) > 1 or t not in seen))
                seen.add(t)
        return query

    @property
    def stats(self) -> DataFrame:
        return self.units.sparkSession.createDataFrame([(self.of.n_units, self.of.avgdl)], "n_units long, avgdl double")

    @property
    def df(self) -> DataFrame:
        rows = [(a[0], int(self.of.doc[i]), int(self.of.cnt[i])) for i, a in enumerate(self.asked) if len(a) == 1 and self.of.doc[i]]
        return self.units.sparkSession.createDataFrame(rows, "term string, doc long, cnt long")

    @property
    def has_phrases(self) -> bool:
        return any(q.n_phrases for q in self.queries)

    def phrases(self) -> DataFrame:
        """query_id, no and key of each phrase in each unit that holds it."""
        return rank.holding(self.units, self.key, self.queries)

    def best(self, n: int, whole: bool = True) -> DataFrame:
        """query_id, key, score, matched and enough of the best ``n`` of each query, with ``whole`` of those that hold
        all its phrases."""
        return top(rank.best(self.units, self.key, self.queries, self.of, n, whole), self.key, n).drop("rank")

    def search(self, limit: int) -> DataFrame:
        """What ``search`` gives."""
        hits = top(self.best(5 * limit + 20).where("enough"), self.key, limit)
        return hits.select("query_id", F.col("rank").cast("long").alias("rank"), *self.key, "score", "matched")


START, END = "\u0002", "\u0003"


def highlight(text: Column, terms: Column) -> Column:
    """Text with each token that is one of ``terms`` between START and END; tokens and the rest are told apart piece
    by piece, so marks on letters don't matter."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}\p{Co}]+|[^\p{L}\p{N}\p{Co}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(F.array_contains(terms, F.lower(X.fold(p))), F.concat(F.lit(START), p, F.lit(END))).otherwise(p)), "")


def with_snippet(rows: DataFrame, terms: Column, size: int = SNIPPET_WORDS, text: str = "text") -> DataFrame:
    """``rows`` with a column snippet: the window of ``size`` words with most words that hold a term, the earliest of
    equals; dots where it is cut. The hits are a column of their own, so that windows only sum them."""
    keep = rows.columns
    given = rows.withColumn("_w", X.words(F.col(text)))
    hits = F.transform("_w", lambda x: F.when(F.arrays_overlap(X.tokens(x), terms), 1).otherwise(0))
    given = given.select(*keep, "_w", hits.alias("_h"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_h") - size, F.lit(0)))
    given = given.select(*keep, "_w", "_h", F.transform(starts, lambda s: F.struct(F.aggregate(F.slice(F.col("_h"), s + 1, size), F.lit(0), lambda a, x: a + x).alias("n"), (-s).alias("s"))).alias("_s"))
    given = given.select(*keep, "_w", (-F.array_max("_s")["s"]).alias("_at"))
    shown = highlight(F.array_join(F.slice("_w", F.col("_at") + 1, size), " "), terms)
    cut = F.concat(F.when(F.col("_at") > 0, F.lit("... ")).otherwise(F.lit("")), shown, F.when(F.col("_at") + size < F.size("_w"), F.lit(" ...")).otherwise(F.lit("")))
    return given.select(*keep, cut.alias("snippet"))
