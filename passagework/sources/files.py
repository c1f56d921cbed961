"""Folders and the text of files."""

from __future__ import annotations

import codecs
import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..schema import DEFAULT_PATTERNS, Limits
from . import pdf

GUESS_FROM = 1 << 20


def resolve_folder(folder: str) -> str:
    """The real path of a folder; an error where it can't be reached."""
    path = os.path.realpath(folder, strict=True)
    if not os.path.isdir(path):
        raise NotADirectoryError(path)
    return path


#: Flags of files that are only in the cloud: offline, recalled on open, recalled on data access; dataless.
CLOUD_ATTRIBUTES, CLOUD_FLAGS = 0x1000 | 0x40000 | 0x400000, 0x40000000
ENTRIES = "path string, folder boolean, size long, modified_secs long, cloud_only boolean, unreadable boolean"


def cloud_only(status: os.stat_result) -> bool:
    """Whether reading the file would fetch it first; false where the system doesn't say."""
    return bool(getattr(status, "st_file_attributes", 0) & CLOUD_ATTRIBUTES or getattr(status, "st_flags", 0) & CLOUD_FLAGS)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is in each folder, links left out; a folder that can't be listed gives one row."""
    names = [f.split()[0] for f in ENTRIES.split(", ")]
    for batch in batches:
        rows = []
        for folder in batch["path"]:
            try:
                with os.scandir(folder) as entries:
                    for e in entries:
                        path = e.path.encode("utf-8", "replace").decode()
                        if e.is_symlink():
                            continue
                        if e.is_dir(follow_symlinks=False):
                            rows.append((path, True, 0, 0, False, False))
                        elif e.is_file(follow_symlinks=False):
                            status = e.stat(follow_symlinks=False)
                            rows.append((path, False, status.st_size, int(status.st_mtime), cloud_only(status), False))
            except OSError:
                rows.append((folder, True, 0, 0, False, True))
        yield pd.DataFrame(rows, columns=names)


class Walk:
    """The entries below a folder that every executor sees under the same path, listed a level at a time by all tasks.
    Hidden and excluded folders are not entered, links not followed, and no file is opened."""

    def __init__(self, spark: SparkSession, root: str, patterns: list[str] | None = None, folders: list[str] | None = None):
        path = F.col("path")
        keep = ~P.hidden(path, root) & ~P.excluded(path, root, DEFAULT_PATTERNS if patterns is None else patterns, folders or [])
        self.levels: list[DataFrame] = []
        tasks = spark.sparkContext.defaultParallelism
        frontier = spark.createDataFrame([(root,)], "path string")
        while not self.levels or not frontier.isEmpty():
            level = frontier.repartition(tasks).mapInPandas(_entries, ENTRIES).where(F.col("unreadable") | keep).cache()
            self.levels.append(level)
            frontier = level.where("folder and not unreadable").select("path")
        found = self.levels[0]
        for level in self.levels[1:]:
            found = found.unionByName(level)
        self.files = found.where("not folder").select("path", "size", "modified_secs", "cloud_only")
        self.unreadable = found.where("unreadable").select("path")

    def release(self) -> None:
        for level in self.levels:
            level.unpersist()


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, folders: list[str] | None = None) -> DataFrame:
    """path, size, modified_secs and cloud_only of the files below ``root``, by path."""
    return Walk(spark, root, patterns, folders).files.orderBy("path")


def utf16_without_mark(data: bytes) -> str | None:
    """UTF-16 told by its zero bytes: Latin text has one in every other byte."""
    sample = data[: min(len(data), 4096) & ~1]
    pairs = len(sample) // 2
    if pairs < 8:
        return None
    first, second = sample[::2].count(0), sample[1::2].count(0)
    if second * 10 >= pairs * 3 and first * 20 <= pairs:
        return "utf-16-le"
    if first * 10 >= pairs * 3 and second * 20 <= pairs:
        return "utf-16-be"
    return None


def _legacy(data: bytes) -> str:
    """The likeliest of three code pages: the one whose letters beyond ASCII form words of one script. Two accented
    letters running stand in Latin texts too, so of another script's words, each once, half the letters must be in words of three or more."""
    sample = data[:GUESS_FROM]
    best, chosen = None, "cp1252"
    for name, script in (("cp1252", "À-ÖØ-öø-ÿŒœŠšŸŽž"), ("cp1251", "Ѐ-ӿ"), ("cp1256", "؀-ۿ")):
        text = sample.decode(name, "replace")
        foreign = len(re.findall(r"[^\x00-\x7f]", text)) or 1
        inside = len(re.findall(f"[{script}]", text)) / foreign
        joined = len(re.findall(f"[{script}][{script}]", text)) / foreign
        if name == "cp1251":  # Cyrillic words don't change from small letters to capitals
            joined -= 3 * len(re.findall("[а-яё][А-ЯЁ]", text)) / foreign
        if name != "cp1252":  # a word is of one script
            found = {w: len(re.findall(f"[{script}]", w)) for w in re.findall(f"[A-Za-z]*[{script}][A-Za-z{script}]*", text)}
            if 2 * sum(n for w, n in found.items() if n == len(w) > 2) < sum(found.values()):
                continue
            joined -= 2 * len(re.findall(f"[A-Za-z][{script}]|[{script}][A-Za-z]", text)) / foreign
        # whole words of another script beat single accented letters
        worth = inside + (joined if name != "cp1252" else 0.5 * (joined < 0.3))
        if best is None or worth > best:
            best, chosen = worth, name
    return chosen


def decode(data: bytes) -> str:
    """Text in whatever encoding; bytes that don't fit become U+FFFD."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    if name := utf16_without_mark(data):
        return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode(_legacy(data), "replace")


@F.pandas_udf(T.StringType())
def decode_text(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in contents:
        yield batch.map(lambda b: None if b is None else decode(bytes(b)))


CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
READ = "path string, hash string, pages array<string>, paged boolean, reason string"


def read_file(path: str, limits: Limits) -> tuple[str | None, list[str] | None, bool, str | None]:
    """(hash of the bytes, page texts, whether the pages are real, reason why there is no text)."""
    try:
        with os.fdopen(os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0)), "rb") as file:
            if os.fstat(file.fileno()).st_size > limits.max_file_bytes:
                return None, None, False, "too-large"
            data = file.read(limits.max_file_bytes + 1)
    except OSError:
        return None, None, False, "cannot-open"
    if len(data) > limits.max_file_bytes:
        return None, None, False, "too-large"
    digest, paged = hashlib.sha256(data).hexdigest(), path.lower().endswith(".pdf")
    try:
        pages = [CONTROLS.sub("", t) for t in (pdf.pages(data, limits) if paged else [decode(data)])]
    except pdf.Refused as refused:
        return digest, None, paged, refused.reason
    if sum(len(t.encode("utf-8", "replace")) for t in pages) > limits.max_text_bytes:
        return digest, None, paged, "too-large"
    if paged and not any(t.strip() for t in pages):
        return digest, None, paged, "needs-ocr"
    return digest, pages, paged, None


def read_files(wanted: DataFrame, limits: Limits | None = None) -> DataFrame:
    """path, hash, pages, paged and reason of the files of ``wanted`` (path), and of no others. One file is held at a
    time, and is not read beyond its limits."""
    limits = limits or Limits()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                digest, pages, paged, reason = read_file(path, limits)
                yield pd.DataFrame({"path": [path], "hash": [digest], "pages": [pages], "paged": [paged], "reason": [reason]})

    return wanted.select("path").repartition(wanted.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, READ)


def read_texts(spark: SparkSession, folder: str, limits: Limits | None = None) -> DataFrame:
    """path, hash, text and reason of the text files that a scan of ``folder`` finds."""
    wanted = scan(spark, folder).where(P.kind(F.col("path")) == "text")
    return read_files(wanted, limits).select("path", "hash", F.get("pages", F.lit(0)).alias("text"), "reason")
