"""Settings, logs, sessions and checks beside an index: small files on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import time
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KINDS, Limits

SETTINGS_VERSION = 2
DEFAULTS = {"version": SETTINGS_VERSION, "folders": [], "excluded_folders": [], "patterns": None, "paused": None, "pause_on_battery": True, "limits": {"megabytes": 200, "pages": 5000}}
LOG_BYTES, LOG_FILES = 1 << 20, 3
LOW_DISK = 1 << 30
#: Why indexing stands still.
PAUSES = ("you", "low-disk", "newer-index", "safe-mode", "battery", "index-away")
#: Starts in a row that didn't end cleanly before the next is a safe one.
SAFE_AFTER = 2


def _replace(path: Path, text: str) -> None:
    new = path.with_suffix(path.suffix + ".new")
    with open(new, "w", encoding="utf-8") as file:
        file.write(text)
        file.flush()
        os.fsync(file.fileno())
    os.replace(new, path)


class Settings:
    """A JSON file, written whole; the previous one is kept and taken where the file is damaged, else the defaults are."""

    def __init__(self, folder: str):
        self.path = Path(folder) / "settings.json"
        self.previous = self.path.with_suffix(".json.previous")
        self.outcome = "fresh"
        self.values = dict(DEFAULTS)
        for path, outcome in ((self.path, "fine"), (self.previous, "previous")):
            try:
                found = json.loads(path.read_text(encoding="utf-8"))
                if isinstance(found, dict):
                    self.values, self.outcome = self.upgraded(found), outcome
                    return
            except FileNotFoundError:
                continue
            except (OSError, ValueError, TypeError, AttributeError, KeyError):
                self.outcome = "damaged"

    @staticmethod
    def upgraded(found: dict) -> dict:
        """Version 1 had a single folder and its limit in bytes."""
        if found.get("version", 1) < 2:
            found = {k: v for k, v in found.items() if k not in ("folder", "max_bytes")} | {"folders": found.get("folders") or ([found["folder"]] if found.get("folder") else [])} | ({"limits": DEFAULTS["limits"] | {"megabytes": max(1, found["max_bytes"] >> 20)}} if "max_bytes" in found else {})
        return DEFAULTS | found | {"version": SETTINGS_VERSION}

    def save(self, **values) -> None:
        self.values |= values
        self.path.parent.mkdir(parents=True, exist_ok=True)
        if self.path.exists():
            shutil.copyfile(self.path, self.previous)
        _replace(self.path, json.dumps(self.values, ensure_ascii=False))

    def limits(self) -> Limits:
        held = self.values["limits"]
        return Limits(max_file_bytes=int(held["megabytes"]) << 20, max_pages=int(held["pages"]))


class Log:
    """Lines of JSON in a file of ``LOG_BYTES`` at most; older ones move on to .1, .2 and go. Values that may name a
    user's files are written as private and only where ``private`` is on."""

    def __init__(self, folder: str, private: bool = False):
        self.path, self.private = Path(folder) / "log.jsonl", private
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def write(self, level: str, event: str, values: dict | None = None, private: dict | None = None) -> None:
        line = {"t": int(time.time()), "level": level, "event": event, "private": bool(private and self.private)} | ({"values": values} if values else {}) | ({"private_values": private} if private and self.private else {})
        text = json.dumps(line, ensure_ascii=False) + "\n"
        if self.path.exists() and self.path.stat().st_size + len(text.encode()) > LOG_BYTES:
            for n in range(LOG_FILES - 1, 0, -1):
                older = self.path if n == 1 else Path(f"{self.path}.{n - 1}")
                if older.exists():
                    os.replace(older, f"{self.path}.{n}")
        with open(self.path, "a", encoding="utf-8") as file:
            file.write(text)

    def tail(self, n: int) -> list[str]:
        """The last ``n`` lines over all files, oldest first."""
        lines: list[str] = []
        for path in [Path(f"{self.path}.{i}") for i in range(LOG_FILES - 1, 0, -1)] + [self.path]:
            if path.exists():
                lines += path.read_text(encoding="utf-8", errors="replace").splitlines()
        return lines[-n:]


def public_lines(lines: Iterable[str]) -> Iterator[str]:
    """Lines that say they aren't private; a line is private unless proven otherwise."""
    for line in lines:
        try:
            if json.loads(line)["private"] is False:
                yield line
        except (ValueError, KeyError, TypeError):
            continue


def crash_reports(folder: str, n: int = 5) -> list[str]:
    """The newest crash reports, newest first."""
    found = [p for p in Path(folder).glob("crash-*.txt") if p.is_file()]
    return [str(p) for p in sorted(found, key=lambda p: (p.stat().st_mtime, p.name), reverse=True)[:n]]


class Session:
    """How many runs in a row before this one ended uncleanly; a missing or damaged record counts as none."""

    def __init__(self, folder: str):
        self.path = Path(folder) / "session.json"
        try:
            found = json.loads(self.path.read_text())
            self.unclean = int(found["unclean"]) + 1 if found["running"] else 0
        except (OSError, ValueError, KeyError, TypeError):
            self.unclean = 0
        self.path.parent.mkdir(parents=True, exist_ok=True)
        _replace(self.path, json.dumps({"running": True, "unclean": self.unclean}))

    @property
    def safe_mode(self) -> bool:
        return self.unclean >= SAFE_AFTER

    def end(self) -> None:
        _replace(self.path, json.dumps({"running": False, "unclean": 0}))


def unclean_streaks(starts: DataFrame, run: str, clean: str, order: str) -> DataFrame:
    """The same over a table of runs: for each run of a machine, how many before it in a row didn't end cleanly."""
    from pyspark.sql import Window as W

    own = W.partitionBy(run).orderBy(order)
    last_clean = F.max(F.when(F.col(clean), F.col("_n"))).over(own.rowsBetween(W.unboundedPreceding, -1))
    numbered = starts.withColumn("_n", F.row_number().over(own))
    return numbered.withColumn("unclean", (F.col("_n") - 1 - F.coalesce(last_clean, F.lit(0))).cast("long")).drop("_n")


def pause_reason(asked: bool, free: int | None, index: str, unclean: int, on_battery: bool) -> str | None:
    """Why indexing stands still, or null. ``free``: bytes of disk, null where unknown, which isn't low. ``index``: the
    outcome of opening it."""
    if asked:
        return "you"
    if free is not None and free < LOW_DISK:
        return "low-disk"
    if index == "newer":
        return "newer-index"
    if index == "away":
        return "index-away"
    if unclean >= SAFE_AFTER:
        return "safe-mode"
    return "battery" if on_battery else None


def free_bytes(path: str) -> int | None:
    try:
        return shutil.disk_usage(path).free
    except OSError:
        return None


def may_open(path: str) -> bool:
    """Whether a result may be handed to the system: a file of a kind that is read, and there."""
    return os.path.splitext(path)[1].lower().lstrip(".") in KINDS and os.path.isfile(path)


def allowed_download(url: str, prefix: str) -> bool:
    """Whether a url is a file of one release below ``prefix``: two plain path parts and nothing else."""
    plain = r"(?!\.{1,2}(?:/|$))[A-Za-z0-9._-]+"
    return url.startswith(prefix) and re.fullmatch(f"{plain}/{plain}", url[len(prefix) :]) is not None


def verified(path: str, sha256: str, places: list[str]) -> str:
    """The path of a model file that lies in one of the known places and has the digest; an error otherwise."""
    real = os.path.realpath(path)
    if not any(os.path.commonpath([real, os.path.realpath(p)]) == os.path.realpath(p) for p in places):
        raise PermissionError(f"{path} is in none of the known places")
    digest = hashlib.sha256()
    with open(real, "rb") as file:
        while piece := file.read(1 << 20):
            digest.update(piece)
    if digest.hexdigest() != sha256.lower():
        raise ValueError(f"{path} isn't the file that was published")
    return real


def find_model(name: str, places: list[str], sha256: str) -> str | None:
    """The first of the places that holds the model, checked."""
    for place in places:
        if os.path.isfile(path := os.path.join(place, name)):
            return verified(path, sha256, places)
    return None


def model_identity(name: str, revision: str, dims: int) -> str:
    """As stored: name, the first twelve of the revision, and dimensions."""
    return f"{name}@{revision[:12]} {dims}"


def delete_everything(spark: SparkSession, index: str, folder: str) -> None:
    """Removes the index, settings, logs and the session record; the user's own files stay."""
    from .store import Store

    Store(spark, index).delete_all()
    for pattern in ("settings.json*", "log.jsonl*", "session.json*", "crash-*.txt"):
        for path in Path(folder).glob(pattern):
            path.unlink()


def diagnostics(problems: DataFrame, settings: Settings, log: Log, with_paths: bool = False, lines: int = 300) -> dict:
    """A report: problems by code with parked ones, settings, public log lines; paths only where asked for."""
    from ..operators import maintenance as M

    grouped = problems.groupBy(F.col("reason").alias("code")).agg(F.count("*").alias("n"), F.count_if(M.parked(F.col("reason"), F.col("attempts"))).alias("parked")).orderBy(F.desc("n"), "code")
    shown = {k: v for k, v in settings.values.items() if with_paths or k not in ("folders", "excluded_folders", "patterns")}
    return {"problems": [r.asDict() for r in grouped.collect()], "settings": shown, "log": list(public_lines(log.tail(lines))), "crashes": [os.path.basename(p) for p in crash_reports(str(log.path.parent))]}
