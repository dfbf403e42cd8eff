"""Text normalisation as column expressions; white space and digits mean the Unicode ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrisk import lexicon as lx

WS_INNER = r"\s\x0B\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_INNER}]"
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"
LINE_ENDS = r"\r\n|[\n\x0B\x0C\r\x1c-\x1e\x85\u2028\u2029]"
WIDE_DIGITS = ("０１２３４５６７８９", "0123456789")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def ascii_digits(c: Column) -> Column:
    return F.translate(c, *WIDE_DIGITS)


def capture(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null for no match or an empty group."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def clean(c: Column) -> Column:
    """Line ends, watermark strings, blank runs and outer white space; null gives an empty text."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    c = F.regexp_replace(c, r"[A-Za-z0-9_-]{24,}~~", " ")
    c = F.regexp_replace(c, rf"(?:\n{WS}*){{3,}}", "\n\n")
    return strip(F.regexp_replace(c, r"[ \t]{2,}", " "))


def collapsed(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, f"{WS}+", " "))


def lines(c: Column) -> Column:
    """Non-blank lines with white space collapsed."""
    return F.filter(F.transform(F.split(c, "\n"), collapsed), lambda x: x != "")


def compact(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{WS_INNER}:：;；、,，.。/\\|_-]+", "")


def heading(c: Column) -> Column:
    """The section heading that a line is, or an empty string."""
    return F.when(compact(c).isin(*lx.HEADINGS), compact(c)).otherwise("")


def evidence(text: Column, hit, limit: int = 3) -> Column:
    """The first lines with a hit, each cut to 180 characters, joined. ``hit``: line -> boolean."""
    found = F.filter(F.filter(F.transform(F.split(text, LINE_ENDS), collapsed), lambda x: x != ""), hit)
    return F.array_join(F.transform(F.slice(found, 1, limit), lambda x: F.substring(x, 1, 180)), " | ")


def quality_score(text: Column) -> Column:
    """How well extracted text is structured; -1 for a blank text."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_ENDS), strip), lambda x: x != "")
    n = F.size(parts)
    short = F.size(F.filter(parts, lambda x: F.length(x) <= 2))
    meaningful = F.size(F.filter(parts, lambda x: x.rlike("[一-龥A-Za-z]{3,}")))
    total = F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))
    bonus = F.when(F.try_element_at(parts, F.lit(1)).rlike("[一-龥]{2,4}"), 50).otherwise(0)
    return F.when(n == 0, F.lit(-1.0)).otherwise(meaningful * 50 + total.cast("double") / n * 5 + bonus - short * 10)


def legacy_clean(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[~`();•–-]", ""))


def deep_clean(c: Column) -> Column:
    """Hexadecimal watermarks and gaps inside words; newlines count as gaps."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "[a-f0-9]{32,}", "")
    c = F.regexp_replace(c, f"([一-龥]){WS}+([一-龥])", "$1$2")
    c = F.regexp_replace(c, f"([a-zA-Z0-9]){WS}+([a-zA-Z0-9])", "$1$2")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n"))


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", "")


def occurrences(c: Column, word: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def safe_stem(name: Column, fallback: Column) -> Column:
    """A file stem without characters that file systems forbid."""
    base = F.substring_index(F.coalesce(F.nullif(name, F.lit("")), fallback), "/", -1)
    stem = F.when(base.rlike(r"^.+\.[^.]+$") & ~base.rlike(r"^\.+[^.]*$"), F.regexp_replace(base, r"\.[^.]+$", "")).otherwise(base)
    cleaned = F.btrim(F.regexp_replace(stem, r'[<>:"/\\|?*\x00-\x1f]+', "_"), F.lit(" ._"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), fallback)


def file_name_part(filename: Column) -> Column:
    """The name that a file name ends with."""
    return capture(filename, r"[-_]([^-_]{2,4})\.[^.]+$")
