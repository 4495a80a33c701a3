"""Column expressions over text.  All are JVM-side except ``nfkc``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# White space as a Unicode-aware ``str.split()`` sees it; Java's \s is ASCII.
SPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000"
    "\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f"
    "\u3000"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Typographic characters and their plain spelling.
TYPOGRAPHIC = {
    "“": '"',
    "”": '"',
    "„": '"',
    "‘": "'",
    "’": "'",
    "‚": "'",
    "–": "-",
    "—": "--",
    "…": "...",
    "·": "*",
    "•": "*",
}

# Zero-width and invisible code points that are deleted.
INVISIBLE = r"[\u200b-\u200f\u2060-\u2064\ufeff]"

NUMBER_LINE = r"(?U)^\s*[-–—]?\s*\d+\s*[-–—]?\s*$"
PAGE_MARKER = r"(?iU)^page\s+\d+(\s+of\s+\d+)?\s*$"

# Words whose share marks a text as English, and the share that must be passed.
ENGLISH_WORDS = (
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "it", "for", "not", "on", "with", "he", "as", "you",
    "do", "at", "this", "but", "his", "by", "from", "they", "we", "say", "her", "she", "or", "an", "will", "my",
    "one", "all", "would", "there", "their", "what", "so", "up", "out", "if", "about", "who", "get", "which", "go",
    "me", "is", "are", "was", "were", "been", "being", "has", "had", "did", "can", "may", "than", "then", "them",
    "these", "those", "just", "also", "very", "when", "where", "how", "each", "other", "some", "such", "only", "own",
    "same", "too", "after", "before",
)
ENGLISH_SHARE = 0.15
LANGUAGE_SAMPLE = 2000
# ---------------------------------------------------------------------------


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def strip_left(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.array_remove(F.split(c, SPACE_CLASS + "+"), "")


def terms(c: Column) -> Column:
    """Lower-cased words, punctuation attached: the BM25 vocabulary."""
    return words(F.lower(c))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def lines(c: Column) -> Column:
    """Lines without their terminator; a final terminator adds no empty line."""
    body = F.regexp_replace(c, f"(?:{LINE_BREAK})\\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK))


def tokens_estimate(c: Column, least: int = 1) -> Column:
    """Four characters per token, never below ``least``."""
    return F.greatest(F.lit(least), F.floor(F.length(c) / 4).cast("int"))


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def clean_whitespace(c: Column) -> Column:
    spaced = F.regexp_replace(c, " {2,}", " ")
    stripped = F.array_join(F.transform(lines(spaced), strip), "\n")
    return strip(collapse_newlines(stripped))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def nfkc(c: Column) -> Column:
    """NFKC form.  ASCII text is its own NFKC form and is not sent to Python."""
    needs = F.when(c.rlike(r"[^\x00-\x7f]"), c)
    return F.coalesce(_nfkc(needs), c)


def replace_typographic(c: Column) -> Column:
    single = {old: new for old, new in TYPOGRAPHIC.items() if len(new) == 1}
    out = F.translate(c, "".join(single), "".join(single.values()))
    for old, new in TYPOGRAPHIC.items():
        if len(new) > 1:
            out = F.replace(out, F.lit(old), F.lit(new))
    return out


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def clean_unicode(c: Column) -> Column:
    return strip_invisible(replace_typographic(nfkc(c)))


def is_number_line(line: Column) -> Column:
    return F.coalesce(line.rlike(NUMBER_LINE), F.lit(False))


def is_page_marker(line: Column) -> Column:
    return F.coalesce(strip(line).rlike(PAGE_MARKER), F.lit(False))


def collapse_blank_lines(c: Column) -> Column:
    emptied = F.regexp_replace(c, r"(?m)^[^\S\n]+$", "")
    return strip(collapse_newlines(emptied))


def repeated(values: Column) -> Column:
    """Values that occur at least twice: equal neighbours after sorting."""
    ordered = F.array_sort(F.array_remove(values, ""))
    return F.array_distinct(F.array_compact(F.zip_with(
        ordered, F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))),
        lambda a, b: F.when(a == b, a))))


def split_blocks(c: Column) -> Column:
    """Page-like blocks: form-feed pages, else runs separated by blank space."""
    return F.when(F.instr(c, "\f") > 0, F.split(c, "\f")).otherwise(F.split(c, r"\n\n\n+"))


def detect_language_en(c: Column) -> Column:
    """``'en'`` when the share of common English words passes the limit, else null.

    The detector is defined on the opening characters of a text.
    """
    sample = terms(F.substring(c, 1, LANGUAGE_SAMPLE))
    known = F.array(*[F.lit(w) for w in ENGLISH_WORDS])
    common = F.size(F.filter(sample, lambda w: F.array_contains(known, w)))
    share = common / F.nullif(F.size(sample), F.lit(0))
    return F.when(share > ENGLISH_SHARE, F.lit("en"))


def title_from_path(path: Column) -> Column:
    """File stem with ``_`` and ``-`` as spaces, or the file name if that is empty."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(strip(F.translate(stem, "_-", "  ")), F.lit("")), name)


def parse_keywords(c: Column) -> Column:
    return F.array_remove(F.transform(F.split(c, "[,;]"), strip), "")


def parse_pdf_date(c: Column) -> Column:
    """``D:YYYYMMDDHHmmSS…`` as a UTC timestamp, else null."""
    digits = F.substring(F.regexp_replace(strip(c), "^D:", ""), 1, 14)
    return F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))


def parse_iso_or_epoch(c: Column) -> Column:
    """Text that starts with an ISO date, or a number of seconds, as a timestamp, else null.

    A bare year is a number, and a time without a date is neither.
    """
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c.try_cast("timestamp"))
    seconds = F.when(c.rlike(r"^[+-]?\d+(\.\d+)?$"), F.timestamp_seconds(c.try_cast("double")))
    return F.coalesce(iso, seconds)
