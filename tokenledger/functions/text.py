"""Text helpers that agree with Python's notion of white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U) makes \s Unicode-aware; U+001C to U+001F count as white space in Python
# but not in Java.
_SPACE = r"\s\x1c-\x1f"


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^[{_SPACE}]+|[{_SPACE}]+\z", "")


def lstrip(text: Column) -> Column:
    """Remove white space at the start."""
    return F.regexp_replace(text, rf"(?U)^[{_SPACE}]+", "")


def rstrip(text: Column) -> Column:
    """Remove white space at the end."""
    return F.regexp_replace(text, rf"(?U)[{_SPACE}]+\z", "")


def strip_ascii(text: Column) -> Column:
    """Remove the ASCII white space that stripping a byte string removes."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\f"))


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.regexp_replace(strip(text), rf"(?U)[{_SPACE}]+", " ")


def word_count(text: Column) -> Column:
    """Number of white-space separated words, at least 1."""
    return F.greatest(
        F.regexp_count(text, F.lit(rf"(?U)[^{_SPACE}]+")), F.lit(1)
    ).cast("long")


def preview(text: Column, limit: int = 280) -> Column:
    """Stripped text cut to ``limit`` characters; null when nothing is left."""
    return F.nullif(F.substring(strip(text), 1, limit), F.lit(""))


def cap_text(text: Column, limit: int) -> Column:
    """Text of at most ``limit`` characters, the last one ``…`` when cut."""
    return F.when(
        F.length(text) > limit,
        F.concat(F.substring(text, 1, limit - 1), F.lit("…")),
    ).otherwise(text)


def display_error(text: Column, limit: int = 240) -> Column:
    """One-line error reason for users: collapsed, cut, never empty."""
    return F.coalesce(
        F.nullif(F.substring(collapse_spaces(text), 1, limit), F.lit("")),
        F.lit("unknown error"),
    )
