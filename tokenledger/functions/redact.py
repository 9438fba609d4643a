"""Removal of personal data and secrets from text columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .settle import settle

# Labels and patterns, in the order in which they run.
DEFAULT_PATTERNS: tuple[tuple[str, str], ...] = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("API_KEY", r"\b(?:sk|pk|rk)-[A-Za-z0-9_-]{16,}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CARD", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,4}\b"),
    ("PHONE", r"\b(?:\+?\d{1,2}[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}\b"),
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
)

# A cheap condition every match of the pattern implies, so that most texts skip
# the regular expression.
_GUARDS: dict[str, Callable[[Column], Column]] = {
    "EMAIL": lambda t: F.contains(t, F.lit("@")),
    "API_KEY": lambda t: F.contains(t, F.lit("k-")),
    "SSN": lambda t: F.contains(t, F.lit("-")) & t.rlike(r"\p{Nd}{4}"),
    "CARD": lambda t: t.rlike(r"\p{Nd}{4}"),
    "PHONE": lambda t: t.rlike(r"\p{Nd}{4}"),
    "IP": lambda t: t.rlike(r"\p{Nd}\.\p{Nd}"),
}

_REDACTED = "text string, hits int"


@dataclass(frozen=True)
class Redactor:
    """What to redact.

    ``extra_patterns`` run after the defaults. ``custom`` replaces all patterns
    by a Python function ``text -> (text, hits)``; it runs as a Pandas UDF.
    """

    enabled: bool = True
    extra_patterns: Sequence[tuple[str, str]] = ()
    custom: Callable[[str], tuple[str, int]] | None = None


def _custom_udf(fn: Callable[[str], tuple[str, int]]):
    @F.pandas_udf(_REDACTED)
    def run(texts: pd.Series) -> pd.DataFrame:
        pairs = [fn(t) if t else (t, 0) for t in texts]
        return pd.DataFrame(pairs, columns=["text", "hits"])

    return run


def _literal(label: str) -> str:
    """A label as replacement text, in which ``\\`` and ``$`` have no meaning."""
    return label.replace("\\", "\\\\").replace("$", "\\$")


def redact_columns(
    df: DataFrame,
    columns: Sequence[str],
    count: str = "pii_redaction_count",
    redactor: Redactor = Redactor(),
    per_label: bool = False,
) -> DataFrame:
    """Redact ``columns`` in place and add the number of substitutions to
    ``count`` (created when missing).

    Each pattern is its own projection over the text the previous one left, so
    the count and the replacement of a stage read the same input and Spark
    evaluates every stage once. ``per_label`` adds one count column per pattern,
    named ``<count>_<label>``.
    """
    if count not in df.columns:
        df = df.withColumn(count, F.lit(0))
    if not redactor.enabled:
        return df
    if redactor.custom is not None:
        run = _custom_udf(redactor.custom)
        df = df.withColumns({f"_redacted_{c}": run(F.col(c)) for c in columns})
        hits = F.col(count)
        for c in columns:
            hits = hits + F.coalesce(F.col(f"_redacted_{c}.hits"), F.lit(0))
        return df.withColumns(
            {count: hits, **{c: F.col(f"_redacted_{c}.text") for c in columns}}
        ).drop(*[f"_redacted_{c}" for c in columns])

    made: dict[str, Column] = {}
    for label, pattern in (*DEFAULT_PATTERNS, *redactor.extra_patterns):
        regex = F.lit("(?U)" + pattern)
        guard = _GUARDS.get(label, F.isnotnull) if (label, pattern) in DEFAULT_PATTERNS else F.isnotnull
        stage: dict[str, Column] = {}
        found = F.lit(0)
        for c in columns:
            text = F.col(c)
            found = found + F.when(
                guard(text), F.regexp_count(text, regex)
            ).otherwise(F.lit(0))
            stage[c] = F.when(
                guard(text), F.regexp_replace(text, regex, F.lit(f"[REDACTED_{_literal(label)}]"))
            ).otherwise(text)
        stage[count] = F.col(count) + found
        if per_label:
            stage[f"{count}_{label}"] = found
        df = df.withColumns(stage)
        made.update(stage)
    return settle(df, list(made))
