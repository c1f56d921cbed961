"""Text as columns: words, index tokens, queries. Everything stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import OPENING_WORDS

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
WORDLIKE = r"[\p{L}\p{N}]"


def _folding() -> tuple[str, str]:
    """Latin letters with marks, and the ASCII letters under them, by Unicode decomposition."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii() and base.isalpha() and all(unicodedata.category(m) == "Mn" for m in marks):
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _folding()


def fold(text: Column) -> Column:
    """Without Latin marks. Translating looks each letter up, so a text of ASCII alone is left as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, MARKED, PLAIN))


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.array_remove(F.split(text, r"\s+", -1), "")


def _small(text: Column) -> Column:
    """In small letters; the dot that a capital leaves as a mark of its own is dropped."""
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("\u0307")), F.translate(low, "\u0307", "")).otherwise(low)


def tokens(text: Column) -> Column:
    """Index tokens: runs of letters and digits, lower case, without Latin marks."""
    return F.regexp_extract_all(fold(_small(text)), F.lit(TOKEN), F.lit(0))


def surfaces(text: Column) -> Column:
    """The tokens as written, in lower case, in step with ``tokens``: folding puts one letter for one."""
    return F.regexp_extract_all(_small(text), F.lit(TOKEN), F.lit(0))


def strip_controls(text: Column) -> Column:
    """Without control characters but tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\p{Cc}&&[^\t\n\r]]", "")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def opening(text: Column, n: int = OPENING_WORDS) -> Column:
    w = words(text)
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, F.lit(" ...")).otherwise(F.lit("")))


def lines(text: Column) -> Column:
    """Lines without their ends; a line feed at the very end starts no line."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def trimmed(word: Column) -> Column:
    """Without outer characters that are no letter or digit."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def distinct_words(text: Column) -> Column:
    """Words with a letter or digit, each once whatever its case, as first written."""
    found = F.filter(words(text), lambda w: w.rlike(WORDLIKE))
    lowered = F.transform(found, F.lower)
    return F.filter(found, lambda w, i: F.array_position(lowered, F.lower(w)) == i + 1)


def _parts(query: Column) -> Column:
    plain = F.translate(F.regexp_replace(query, r"\p{Cc}", " "), "“”„", '"""')
    return F.split(plain, '"', -1)


def _quoted(parts: Column, x: Column, i: Column) -> Column:
    closed = F.size(parts) % 2 == 1
    return (i % 2 == 1) & (closed | (i + 1 < F.size(parts))) & x.rlike(WORDLIKE)


def query_phrases(query: Column) -> Column:
    """Quoted phrases with a letter or digit, white space collapsed. A quote left open quotes nothing."""
    parts = _parts(query)
    return F.transform(F.filter(parts, lambda x, i: _quoted(parts, x, i)), one_line)


def query_words(query: Column) -> Column:
    """The words outside the phrases."""
    parts = _parts(query)
    return distinct_words(F.concat(F.lit(" "), F.array_join(F.filter(parts, lambda x, i: ~_quoted(parts, x, i)), " ")))


def names_and_numbers(line: Column) -> Column:
    """Trimmed words with a digit and four characters, or with an initial capital and five."""
    cut = F.transform(words(line), trimmed)
    return F.filter(cut, lambda w: (w.rlike("[0-9]") & (F.char_length(w) >= 4)) | (w.rlike(r"^\p{Lu}") & (F.char_length(w) >= 5)))
