"""Paths, name patterns and result filters as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KINDS, MAX_PATTERN_CHARS, SYNCED, Filter


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def kind(path: Column) -> Column:
    """text, pdf, or null for files that aren't read."""
    e = extension(path)
    out = None
    for ext, k in KINDS.items():
        out = F.when(e == ext, k) if out is None else out.when(e == ext, k)
    return out


def below(path: Column, root: str) -> Column:
    """The path's components below ``root``."""
    return F.filter(F.split(F.substring(path, len(root.rstrip("/")) + 1, 1 << 30), r"[/\\]"), lambda c: c != "")


def hidden(path: Column, root: str) -> Column:
    return F.exists(below(path, root), lambda c: c.startswith("."))


def glob_regex(pattern: str) -> str:
    """A pattern of * and ? as a regular expression for a whole lower-case name."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c.lower()) for c in pattern) + "$"


def matches(names: Column, patterns: list[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return F.lower(names).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def excluded(path: Column, root: str, patterns: list[str], folders: list[str]) -> Column:
    """In an excluded folder, or with a component below the root that matches a pattern."""
    out = F.exists(below(path, root), lambda c: matches(c, patterns))
    for folder in folders:
        out = out | inside(path, folder)
    return out


def inside(path: Column, folder: str) -> Column:
    f = folder.rstrip("/\\")
    return path.startswith(f) & F.substring(path, len(f) + 1, 1).isin("/", "\\")


def admits(path: Column, modified: Column, f: Filter) -> Column:
    out = F.lit(True)
    if f.folders:
        any_folder = inside(path, f.folders[0])
        for folder in f.folders[1:]:
            any_folder = any_folder | inside(path, folder)
        out = out & any_folder
    if f.extensions:
        out = out & extension(path).isin(*f.extensions)
    if f.modified_since is not None:
        out = out & (modified >= f.modified_since)
    return out


def pattern_fault(pattern: Column) -> Column:
    """Why a pattern can't be used, or null."""
    return (
        F.when(F.regexp_replace(pattern, r"^\s+|\s+$", "") == "", "empty")
        .when(F.char_length(pattern) > MAX_PATTERN_CHARS, "too long")
        .when(pattern.rlike(r"[/\\]"), "separator")
        .when(pattern.rlike(r"\p{Cc}"), "control character")
    )


def synced_by(path: Column, onedrive: list[str] | None = None) -> Column:
    """The service that syncs a folder on the path: OneDrive by the folders that it names itself, the others by name,
    the first one on the path."""
    parts = F.transform(F.split(path, r"[/\\]"), F.lower)
    known = F.get(F.filter(parts, lambda c: c.isin(*SYNCED)), 0)
    out = F.lit(None).cast("string")
    for folder, service in SYNCED.items():
        out = F.when(known == folder, service).otherwise(out)
    for folder in onedrive or []:
        out = F.when(inside(path, folder) | (path == folder), "OneDrive").otherwise(out)
    return out
