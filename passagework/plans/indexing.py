"""A folder into an index and searches of it: scan, change plan, reading, passages, postings, merge, purge, vectors."""

from __future__ import annotations

import time
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunk, keyword, maintenance, nearest, postings, results
from ..schema import CHUNK_OVERLAP, CHUNK_WORDS, PROBLEMS, Filter, Limits
from ..sources import embed as E
from ..sources import files as S
from ..sources.store import Store
from . import search

KEY = ["hash", "ordinal"]


def cut(read: DataFrame) -> DataFrame:
    """Passages of read contents (hash, pages, paged): of paged ones page by page, of texts with lines."""
    plain = chunk.chunk_words(read.where("not paged").select("hash", F.get("pages", F.lit(0)).alias("text"))).withColumn("page", F.lit(None).cast("long"))
    spread = read.where("paged").select("hash", F.posexplode("pages").alias("page", "text")).withColumn("page", (F.col("page") + 1).cast("long"))
    names = ["hash", "ordinal", "page", "start_line", "end_line", "text"]
    return plain.select(*names).unionByName(chunk.chunk_pages(spread).select(*names))


def index_folder(spark: SparkSession, store: Store, folder: str, limits: Limits | None = None, now: int | None = None, patterns: list[str] | None = None, excluded: list[str] | None = None) -> dict[str, int]:
    """Counts by action. A folder that can't be reached is an error and changes nothing; what is known below a folder
    that can't be listed is kept; removed files leave with what only they held. Files that the plan doesn't want are
    not opened. Everything is published in one step, and rows that stay are not written again unless some leave."""
    limits = limits or Limits()
    root = S.resolve_folder(folder)
    rebuilt = store.use_pipeline(f"words {CHUNK_WORDS}/{CHUNK_OVERLAP}")
    walk = S.Walk(spark, root, patterns, excluded)
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.cache())
        return df

    try:
        old, problems = store.table("files"), store.table("problems")
        plan = keep(maintenance.change_plan(walk.files, old, problems))
        report = maintenance.report(plan).first().asDict()
        wanted = plan.where("action = 'read'").select("path", "size", "modified_secs")
        read = keep(S.read_files(wanted, limits).join(wanted, "path"))
        good = read.where("reason IS NULL")
        cloud = plan.where("action = 'cloud-new'").select("path", "size", "modified_secs", F.lit("cloud-only").alias("reason"))
        bad = keep(read.where("reason IS NOT NULL").select("path", "size", "modified_secs", "reason").unionByName(cloud))
        known = maintenance.known_paths(old, problems, f"{root}/")
        seen = walk.files.select("path").union(maintenance.under(known, walk.unreadable))
        files, gone = maintenance.purge(maintenance.put_files(old, good.select("path", "size", "modified_secs", "hash")), seen, f"{root}/")
        files, gone = keep(files), keep(gone)
        leaving = keep(old.select("hash").distinct().join(files.select("hash"), "hash", "left_anti"))
        fresh = good.dropDuplicates(["hash"]).join(old.select("hash"), "hash", "left_anti")
        passages = keep(cut(fresh.select("hash", "pages", "paged")))
        new = {"passages": passages, "postings": by_term(postings.postings(passages, KEY)), "lengths": postings.lengths(passages, KEY)}
        problems = maintenance.record_problems(problems, bad).join(good.select("path"), "path", "left_anti")
        inside = F.col("path").startswith(f"{root}/")
        problems = problems.where(~inside).unionByName(problems.where(inside).join(seen, "path", "left_semi")).select(*[f.name for f in PROBLEMS.fields])
        report |= {"added": good.count(), "removed": gone.count(), "not_indexed": bad.count(), "unreadable": walk.unreadable.count(), "rebuilt": int(rebuilt)}
        replaced = {"files": files, "problems": problems}
        if not leaving.isEmpty():
            stay = {name: store.table(name).join(leaving, "hash", "left_anti") for name in (*new, "vectors")}
            replaced |= {name: rows.unionByName(new[name]) if name in new else rows for name, rows in stay.items()}
            replaced["postings"] = by_term(replaced["postings"])
            new = {}
        changed = rebuilt or store.meta("last_scan") is None or report["read"] or report["removed"] or report["cloud_new"]
        when = {"last_scan": str(int(time.time()) if now is None else now)}
        if changed or report["not_indexed"]:
            store.commit(add=new, meta=when, **replaced)
        else:
            store.commit(meta=when)
    finally:
        for df in held:
            df.unpersist()
        walk.release()
    store.vacuum()
    return report


def by_term(index: DataFrame) -> DataFrame:
    """Rows of equal terms side by side, so that a search reads only the row groups of its terms."""
    return index.repartitionByRange(*[F.col(c) for c in ("term", *KEY)]).sortWithinPartitions("term", *KEY)


def embed_missing(store: Store, model: E.Model) -> int:
    """Vectors for the passages that have none, of which there may be many; the number made. Another model's go."""
    store.use_model(model.name)
    missing = nearest.missing(store.table("passages"), store.table("vectors"), KEY)
    n = missing.count()
    if n:
        store.commit(add={"vectors": E.embed(missing, model, KEY)})
    return n


class Stored:
    """What a combined search reads of a stored index. ``terms``: the index tokens of the queries, where they are known;
    only their postings are read then."""

    def __init__(self, store: Store, model: E.Model | None = None, terms: list[str] | None = None):
        self.store, self.model, self.terms = store, model, terms
        self.files, self.passages, self.lengths = (store.table(n) for n in ("files", "passages", "lengths"))

    @cached_property
    def index(self) -> DataFrame:
        held = self.store.table("postings")
        return held if self.terms is None else held.where(F.col("term").isin(*self.terms)) if self.terms else held.limit(0)

    @cached_property
    def stats(self) -> DataFrame:
        return postings.stats(self.lengths)

    @cached_property
    def df(self) -> DataFrame:
        return postings.term_df(self.index, KEY)

    @cached_property
    def vectors(self) -> DataFrame:
        return self.store.table("vectors")

    def query_vectors(self, queries: DataFrame) -> DataFrame:
        plain = queries.select("query_id", F.translate("query", '"“”', "").alias("text"))
        return E.embed(plain, self.model, ["query_id"])

    @property
    def note(self) -> str | None:
        if self.model is None:
            return search.notes(None, self.store.meta("model"), self.passages.count(), 0)
        return search.notes(self.model.name, self.store.meta("model"), self.passages.count(), self.vectors.count())


def ask(store: Store, query: str, limit: int = 10, model: E.Model | None = None, by_name: bool = True, f: Filter | None = None) -> tuple[list[dict], str | None]:
    """(results of one query, a note on the meaning search): rank, path, name, folder, copies, location, snippet and how
    each was found."""
    spark = store.spark
    queries = spark.createDataFrame([(0, query)], "query_id long, query string")
    asked = keyword.parse(queries).select(F.explode(F.concat(X.tokens(F.col("text")), F.array(X.trimmed(F.lower("text"))))).alias("t")).distinct()
    terms = [r[0] for r in asked.collect()]  # of one query
    stored = Stored(store, model, terms)
    note = stored.note
    meaning = model is not None and note not in ("meaning-off", "not-embedded-yet") and not (note or "").startswith("other-model")
    hits = search.search(stored, queries, meaning=meaning, by_name=by_name, f=f).where(F.col("rank") <= limit)
    shown = hits.join(stored.passages, KEY).join(results.copies(stored.files).select("hash", "copies"), "hash")
    shown = keyword.with_snippet(shown, F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>"))
    place = results.location(F.col("page"), F.col("start_line"), F.col("end_line"))
    rows = shown.select("rank", "path", results.shown_name(F.col("path")).alias("name"), results.shown_folder(F.col("path")).alias("folder"), "copies", place.alias("location"), "snippet", "found", "score").orderBy("rank").collect()
    return [r.asDict() for r in rows], note


def status(store: Store) -> dict[str, int]:
    return {"files": store.table("files").count(), "contents": store.table("files").select("hash").distinct().count(), "passages": store.table("passages").count(), "vectors": store.table("vectors").count(), "problems": store.table("problems").count(), "bytes": store.size_bytes()}


def damage(store: Store) -> DataFrame:
    """What is wrong with the stored index, by table: rows that its passages don't give, or that are missing."""
    passages = store.table("passages")
    return maintenance.index_faults(passages, store.table("postings"), store.table("lengths"), store.table("files"), KEY)


def problems(store: Store) -> DataFrame:
    """Files that aren't indexed, by path."""
    return store.table("problems").orderBy("path")
