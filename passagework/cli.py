"""Command line: index a folder, search it by words, meaning and names, show what the index holds."""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import SparkSession

from .operators import maintenance
from .operators.keyword import END, START
from .plans import indexing
from .schema import KINDS, PERIOD_DAYS, Filter
from .sources.embed import HashingModel
from .sources.store import Store

FOUND = {"both": "words and meaning", "keyword": "words", "meaning": "meaning", "name": "name"}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="passagework")
    parser.add_argument("--db", default="passagework-index", help="folder of the index")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("folder")
    index.add_argument("--retry", action="store_true", help="read files again whose reading failed")
    index.add_argument("--exclude", action="append", default=[], help="folder that isn't read")
    index.add_argument("--embed", action="store_true", help="make vectors for the meaning search")
    search = commands.add_parser("search")
    search.add_argument("words", nargs="+")
    search.add_argument("--limit", type=int, default=10)
    search.add_argument("--words-only", action="store_true", help="neither meaning nor names")
    search.add_argument("--folder", action="append", default=[])
    search.add_argument("--kind", action="append", default=[], choices=sorted(KINDS))
    search.add_argument("--since", choices=sorted(PERIOD_DAYS))
    commands.add_parser("status")
    commands.add_parser("problems")
    given = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    store = Store(spark, os.path.abspath(given.db) if "://" not in given.db else given.db)
    if given.command == "index":
        if given.retry:
            store.commit(problems=maintenance.forget_failures(store.table("problems")))
        report = indexing.index_folder(spark, store, given.folder, excluded=[os.path.realpath(f) for f in given.exclude])
        if given.embed:
            report["embedded"] = indexing.embed_missing(store, HashingModel())
        for name, n in report.items():
            print(f"{name}: {n}")
    elif given.command == "search":
        since = int(time.time()) - PERIOD_DAYS[given.since] * 86_400 if given.since else None
        f = Filter(tuple(os.path.realpath(x) for x in given.folder), tuple(given.kind), since)
        model = None if given.words_only else HashingModel()
        hits, note = indexing.ask(store, " ".join(given.words), given.limit, model, not given.words_only, f)
        for r in hits:
            snippet = r["snippet"].replace(START, "[").replace(END, "]")
            print(f"{r['rank']}. {r['path']}" + (f" (+{r['copies'] - 1} identical)" if r["copies"] > 1 else "") + f", {r['location']} (found by {FOUND[r['found']]})\n   {snippet}")
        if note and not given.words_only:
            print(f"note: {note}")
    elif given.command == "problems":
        for r in indexing.problems(store).toLocalIterator():
            print(f"{r.path}: {r.reason}")
    else:
        for name, n in indexing.status(store).items():
            print(f"{name}: {n}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
