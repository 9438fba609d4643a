"""Redaction of personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.redact import DEFAULT_PATTERNS, Redactor, redact_columns
from ..functions.text import preview
from ..operators.process import check
from . import inputs as I
from .registry import query


def staged(table: str, text: str, keep: str, patterns=DEFAULT_PATTERNS, name: str = "stage") -> str:
    """CTEs that apply the patterns one after the other; the last one is
    ``<name>`` with columns ``text`` and ``n_<label>``."""
    ctes, source, counts = [], table, ""
    for i, (label, pattern) in enumerate(patterns):
        here = name if i == len(patterns) - 1 else f"{name}_{i}"
        column = text if i == 0 else "text"
        ctes.append(
            f"{here} AS (SELECT {keep}{counts}, regexp_replace({column}, '{pattern}', '[REDACTED_{label}]', 'g') AS text, "
            f"coalesce(len(regexp_extract_all({column}, '{pattern}')), 0) AS n_{label.lower()} FROM {source})"
        )
        source, counts = here, counts + f", n_{label.lower()}"
    return ", ".join(ctes)


_SUM = " + ".join(f"n_{label.lower()}" for label, _ in DEFAULT_PATTERNS)


def _docs(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", "text")


@query("d1_redact", f"WITH {staged('documents', 'text', 'doc_id')} SELECT doc_id, text FROM stage")
def _(spark, sf):
    return redact_columns(_docs(spark, sf), ["text"]).select("doc_id", "text")


@query("d2_hits", f"WITH {staged('documents', 'text', 'doc_id')} SELECT doc_id, ({_SUM})::INTEGER AS hits FROM stage")
def _(spark, sf):
    return redact_columns(_docs(spark, sf), ["text"], "hits").select("doc_id", "hits")


@query("d2_hits_by_label", f"WITH {staged('documents', 'text', 'doc_id')} SELECT " + ", ".join(
    f"sum(n_{label.lower()})::BIGINT AS {label.lower()}" for label, _ in DEFAULT_PATTERNS) + " FROM stage")
def _(spark, sf):
    hits = redact_columns(_docs(spark, sf), ["text"], "hits", per_label=True)
    return hits.agg(*[F.sum(f"hits_{label}").alias(label.lower()) for label, _ in DEFAULT_PATTERNS])


_EXTRA = (("SHORT_NUMBER", r"\b\d{2,3}\b"),)


@query("d3_extra_patterns", f"WITH {staged('documents', 'text', 'doc_id', (*DEFAULT_PATTERNS, *_EXTRA))} SELECT doc_id, text, ({_SUM} + n_short_number)::INTEGER AS hits FROM stage")
def _(spark, sf):
    return redact_columns(_docs(spark, sf), ["text"], "hits", Redactor(extra_patterns=_EXTRA))


@query("d4_custom_redactor", "SELECT doc_id, '[' || length(text) || ']' AS text, 1 AS hits FROM documents")
def _(spark, sf):
    custom = Redactor(custom=lambda text: (f"[{len(text)}]", 1))
    return redact_columns(_docs(spark, sf), ["text"], "hits", custom)


@query("d5_disabled", "SELECT doc_id, text, 0 AS hits FROM documents")
def _(spark, sf):
    return redact_columns(_docs(spark, sf), ["text"], "hits", Redactor(enabled=False))


@query("d6_second_pass", f"""WITH {I.RAW_LOGS_SQL}
SELECT request_id, 'mail [REDACTED_EMAIL]' AS input_preview, 1 AS pii_redaction_count FROM raw""")
def _(spark, sf):
    logs = check(I.events_json(spark, sf), redact_again=True).logs
    return logs.select("request_id", "input_preview", "pii_redaction_count")


# Three views of the text as the fields of an event.
_FIELDS_SQL = "fields AS (SELECT doc_id, text AS t1, reverse(text) AS t2, substr(text, 1, 500) AS t3 FROM documents)"


@query("d7_event_hits", f"""WITH {_FIELDS_SQL}, {staged('fields', 't1', 'doc_id', name='a')}, {staged('fields', 't2', 'doc_id', name='b')}, {staged('fields', 't3', 'doc_id', name='c')}
SELECT doc_id, (x.h + y.h + z.h)::INTEGER AS pii_redaction_count FROM (SELECT doc_id, {_SUM} AS h FROM a) x
JOIN (SELECT doc_id, {_SUM} AS h FROM b) y USING (doc_id) JOIN (SELECT doc_id, {_SUM} AS h FROM c) z USING (doc_id)""")
def _(spark, sf):
    fields = _docs(spark, sf).select(
        "doc_id", F.col("text").alias("input_preview"), F.reverse("text").alias("output_preview"),
        F.substring("text", 1, 500).alias("error_message"),
    )
    names = ["input_preview", "output_preview", "error_message"]
    return redact_columns(fields, names).select("doc_id", "pii_redaction_count")


_PREVIEW_SQL = r"cut AS (SELECT doc_id, nullif(substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 280), '') AS t FROM documents)"


@query("d8_preview", f"WITH {_PREVIEW_SQL}, {staged('cut', 't', 'doc_id')} SELECT doc_id, text, ({_SUM})::INTEGER AS hits FROM stage")
def _(spark, sf):
    cut = _docs(spark, sf).withColumn("text", preview(F.col("text")))
    return redact_columns(cut, ["text"], "hits")


@query("d9_error_text", f"WITH cut AS (SELECT doc_id, substr(text, 1, 500) AS t FROM documents), {staged('cut', 't', 'doc_id')} SELECT doc_id, text, ({_SUM})::INTEGER AS hits FROM stage")
def _(spark, sf):
    cut = _docs(spark, sf).withColumn("text", F.substring("text", 1, 500))
    return redact_columns(cut, ["text"], "hits")
