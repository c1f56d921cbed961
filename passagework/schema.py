"""Schemas, defaults and fixed values of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

FILES = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("size", T.LongType(), False), T.StructField("modified_secs", T.LongType(), False), T.StructField("hash", T.StringType(), False)])
PASSAGES = T.StructType([T.StructField("hash", T.StringType(), False), T.StructField("ordinal", T.LongType(), False), T.StructField("page", T.LongType()), T.StructField("start_line", T.LongType(), False), T.StructField("end_line", T.LongType(), False), T.StructField("text", T.StringType(), False)])
VECTORS = T.StructType([T.StructField("hash", T.StringType(), False), T.StructField("ordinal", T.LongType(), False), T.StructField("embedding", T.ArrayType(T.DoubleType(), False), False)])
POSTINGS = T.StructType([T.StructField("hash", T.StringType(), False), T.StructField("ordinal", T.LongType(), False), T.StructField("term", T.StringType(), False), T.StructField("surface", T.StringType(), False), T.StructField("tf", T.LongType(), False), T.StructField("positions", T.ArrayType(T.LongType()))])
LENGTHS = T.StructType([T.StructField("hash", T.StringType(), False), T.StructField("ordinal", T.LongType(), False), T.StructField("dl", T.LongType(), False)])
PROBLEMS = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("size", T.LongType(), False), T.StructField("modified_secs", T.LongType(), False), T.StructField("reason", T.StringType(), False), T.StructField("attempts", T.IntegerType(), False)])

SCHEMA_VERSION, OLDEST_UPGRADED = 5, 3

# Search parameters.
KEYWORD_CANDIDATES, MEANING_CANDIDATES, NAME_CANDIDATES = 50, 50, 20
WIDEN = 4
COMMON_SHARE, NAME_COMMON_SHARE = 0.05, 0.5
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
SNIPPET_WORDS, OPENING_WORDS = 24, 30
CHUNK_WORDS, CHUNK_OVERLAP = 200, 30
BULK_SHARE = 0.02
ATTEMPTS_BEFORE_PARKING = 2
CHECK_EVERY_SECS, RETRY_AFTER_SECS = 86_400, 3_600
PERIOD_DAYS = {"week": 7, "month": 31, "year": 366}
MAX_PATTERN_CHARS, MAX_PATTERNS = 200, 500
MAX_MEGABYTES, MAX_PAGES = 2_048, 100_000

# Extensions of the kinds that are read.
KINDS = {"txt": "text", "md": "text", "markdown": "text", "pdf": "pdf"}

# Codes of the reasons why a file isn't indexed, whether each is a failure, and its text.
REASONS = [
    ("needs-ocr", False, "no text layer (a scan?); needs text recognition, not available yet"),
    ("encrypted", False, "protected by a password"),
    ("too-large", False, "over the size, page or text limit"),
    ("cannot-open", False, "could not be opened (access denied, or in use?)"),
    ("damaged", True, "not a readable PDF (damaged?)"),
    ("timed-out", True, "took too long to read and was stopped"),
    ("memory-limit", True, "needed too much memory to read and was stopped"),
    ("crashed", True, "the reader crashed on this file"),
    ("invalid-output", True, "the reader returned invalid data"),
    ("library-missing", True, "PDF support is not installed (PDFium library not found)"),
    ("cloud-only", False, "only in the cloud (OneDrive or similar); not downloaded, so not read"),
]
REASON_CODES = [code for code, _, _ in REASONS]
FAILURES = [code for code, failed, _ in REASONS if failed]

# Name patterns that a scan leaves out by default.
DEFAULT_PATTERNS = [
    "$RECYCLE.BIN", "System Volume Information", "desktop.ini", "Thumbs.db", "~$*",
    "node_modules", "__pycache__", "site-packages", "bower_components", "venv",
    "*.kdbx", "*.kdb", "*.key", "*.pem", "*.pfx", "*.p12", "*.ppk", "id_rsa*", "id_dsa*", "id_ecdsa*", "id_ed25519*",
    "*passwords*", "*recovery*codes*", "*backup*codes*",
]

# Folder names of services that copy files to the internet.
SYNCED = {"dropbox": "Dropbox", "google drive": "Google Drive", "my drive": "Google Drive", "iclouddrive": "iCloud Drive"}


@dataclass(frozen=True)
class Limits:
    max_file_bytes: int = 200 << 20
    max_pages: int = 5_000
    max_text_bytes: int = 64 << 20
    timeout_secs: int = 60
    memory_bytes: int = 512 << 20


@dataclass(frozen=True)
class Filter:
    """What results may come from; empty parts admit all."""

    folders: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    modified_since: int | None = None

    @property
    def empty(self) -> bool:
        return not (self.folders or self.extensions or self.modified_since is not None)
