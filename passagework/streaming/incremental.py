"""Incremental indexing: a new listing triggers a full difference against the stored files.

A file stream reports new paths only, neither edits nor removals, so a batch of it is a trigger and the change plan is
made from the whole listing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import maintenance as M


def watch(spark: SparkSession, listings: str, schema: str, stored: Callable[[], tuple[DataFrame, DataFrame]], apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs once over the listings (parquet, each a whole scan) that are new, oldest first, and hands each one's change
    plan to ``apply``. ``stored`` gives the indexed files and problems at that time."""

    def batch(scan: DataFrame, number: int) -> None:
        if not scan.isEmpty():
            files, problems = stored()
            apply(M.change_plan(scan, files, problems), number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(listings)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Runner:
    """Indexing in two stages, words and then meaning, with a checkpoint between: the listings stream makes the words
    index, and vectors follow for what it left without. Asking again while a run goes on makes one more run after it,
    however often it was asked; a pause ends the run between two steps, and the next one goes on from there."""

    def __init__(self, words: Callable[[], object], meaning: Callable[[], object] | None = None):
        self.steps = [words, *([meaning] if meaning else [])]
        self.paused: str | None = None
        self._again, self._running, self._at = False, False, 0

    def ask(self) -> int:
        """Runs, or notes that another run is wanted; the number of steps done."""
        if self._running:
            self._again = True
            return 0
        done, self._running = 0, True
        try:
            while True:
                self._again = False
                while self._at < len(self.steps):
                    if self.paused is not None:
                        return done
                    self.steps[self._at]()
                    self._at += 1
                    done += 1
                self._at = 0
                if not self._again:
                    return done
        finally:
            self._running = False

    def pause(self, reason: str = "you") -> None:
        self.paused = reason

    def resume(self) -> int:
        self.paused = None
        return self.ask()
