"""Scanning and regular-expression helpers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character of XML Schema: everything but punctuation, separators and other characters.
WORD_CLASS = r"[^\p{P}\p{Z}\p{C}]"
_ESCAPES = {"w": WORD_CLASS, "W": r"[\p{P}\p{Z}\p{C}]", "d": r"\p{Nd}", "D": r"\P{Nd}", "i": r"[\p{L}_:]", "c": r"[\p{L}\p{Nd}._:\-]"}


def java_regex(pattern: str) -> str:
    """An XML Schema pattern as a Java one; classes inside brackets become nested classes."""
    return re.sub(r"\\([wWdDic])", lambda m: _ESCAPES[m[1]], pattern)


def scan(text: Column, pattern: str) -> Column:
    """All non-empty matches of an XML Schema pattern, in order; empty for null."""
    if pattern == r"\w*":  # the default of texts, without the empty matches between words
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS + "+"), F.lit(0))
    java = java_regex(pattern)
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java), F.lit(0))
    return F.filter(found, lambda t: t != "")


def matches(text: Column, pattern: str) -> Column:
    """Whether the whole text matches."""
    return text.rlike(f"^(?:{java_regex(pattern)})$")


def substitute(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, java_regex(pattern), replacement)


def split_text(text: Column, pattern: str) -> Column:
    return F.split(text, java_regex(pattern))


def limit_length(text: Column, length: int) -> Column:
    """Text of at most ``length`` characters, the last three dots where it was cut."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)


def normalise_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def alnum_only(text: Column) -> Column:
    """Letters and digits, everything else a blank."""
    return normalise_blanks(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
