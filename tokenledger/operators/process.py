"""From validated events to log rows and dead letters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enrich import enrich
from ..functions.json import overlaid
from ..functions.redact import Redactor, redact_columns
from ..schemas import INFERENCE_LOGS
from .validate import storage_error, validate

ERROR_CHARS = 1000


@dataclass(frozen=True)
class Outcome:
    """Two views of the same checked events.

    Both read ``checked``; persist that one when both are written.
    """

    checked: DataFrame

    @property
    def logs(self) -> DataFrame:
        return to_logs(self.checked.filter(F.col("error").isNull()))

    @property
    def dead_letters(self) -> DataFrame:
        return to_dead_letters(self.checked.filter(F.col("error").isNotNull()))


def check(
    bronze: DataFrame,
    prices: DataFrame | None = None,
    redact_again: bool = False,
    redactor: Redactor = Redactor(),
) -> Outcome:
    """Validate and enrich every event; nothing is dropped.

    Events that :func:`validate` has typed already are not validated again.
    ``redact_again`` turns on the second redaction pass over previews and error
    text, whose hits are added to those the producer counted.
    """
    df = bronze if "errors" in bronze.columns else validate(bronze)
    df = enrich(df, prices)
    df = df.withColumn(
        "client_metadata", overlaid(F.col("client_metadata"), F.col("tags"))
    )
    if redact_again:
        df = redact_columns(
            df, ["input_preview", "output_preview", "error_message"], redactor=redactor
        )
    refused = storage_error(df)
    df = df.withColumn("_refused", F.when(F.col("error").isNull(), refused))
    return Outcome(
        df.withColumns(
            {
                "stage": F.when(F.col("error").isNotNull(), F.lit("validation")).when(
                    F.col("_refused").isNotNull(), F.lit("processing")
                ),
                "error": F.coalesce("error", "_refused"),
            }
        ).drop("_refused")
    )


def _log_columns(events: DataFrame, processed_at: Column, given: Column | None = None) -> list[Column]:
    """The stored columns of an event; null where ``given`` is not true. A position stays."""
    filled = {"received_at": F.coalesce(F.col("received_at"), processed_at), "processed_at": processed_at}

    def value(name: str) -> Column:
        column = filled.get(name, F.col(name))
        return column if given is None else F.when(given, column)

    return [
        *[value(f.name).cast(f.dataType).alias(f.name) for f in INFERENCE_LOGS.fields],
        *[F.col(c) for c in ("pos",) if c in events.columns],
    ]


def to_logs(valid: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """The stored columns, with both arrival times filled in."""
    return valid.select(*_log_columns(valid, F.current_timestamp() if processed_at is None else processed_at))


def _dead_letter() -> list[Column]:
    unparseable = F.exists("errors", lambda e: e["code"] == "unparseable")
    return [
        F.substring("error", 1, ERROR_CHARS).alias("error"),
        F.when(
            unparseable, F.to_json(F.struct(F.col("value").alias("__unparseable__")))
        ).otherwise(F.col("value")).alias("data"),
        F.col("stage").alias("stage"),
        F.coalesce("received_at", F.current_timestamp()).alias("received_at"),
    ]


def to_dead_letters(bad: DataFrame) -> DataFrame:
    """Error text cut to 1000 characters, and the payload as JSON text.

    Text that is no JSON is wrapped so that the payload column always is.
    """
    return bad.select(*_dead_letter())


def to_rows(checked: DataFrame, processed_at: Column, *also: Column) -> DataFrame:
    """Good and bad events as one table: the columns of :func:`to_logs`, null for bad
    ones, and ``_dead``, what :func:`to_dead_letters` makes of a bad one, else null.
    Payloads of good events are left out. ``also`` are columns to keep besides."""
    good = F.col("error").isNull()
    return checked.select(
        *_log_columns(checked, processed_at, good), F.when(~good, F.struct(*_dead_letter())).alias("_dead"), good.alias("_good"), *also
    )
