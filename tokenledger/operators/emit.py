"""From captured events to what a producer sends: sampled, capped, as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.caps import cap_events
from ..session import written
from .sampling import KeepAll, Sampler, sample

MAX_EVENTS = 500


def _sent(name: str, kind: str) -> Column:
    """A field as it is sent; instants in UTC with microseconds."""
    if kind.startswith("timestamp"):
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(name)
    return F.col(name)


def to_payload(events: DataFrame) -> DataFrame:
    """``request_id`` and the event as JSON text in ``value``; null fields are left out.

    Instants are written in the session's time zone, which the library sets to UTC.
    """
    fields = F.struct(*[_sent(name, kind) for name, kind in events.dtypes])
    return events.select("request_id", F.to_json(fields).alias("value"))


def emit(events: DataFrame, sampler: Sampler = KeepAll()) -> DataFrame:
    """Sample events, bound what callers control, and write them as JSON."""
    return to_payload(cap_events(sample(events, sampler)))


def to_envelopes(payload: DataFrame, size: int = 100) -> DataFrame:
    """``batch_id`` and an ``{"events": [...]}`` document of at most ``size`` events.

    Events next to each other in a partition share a document, so none is larger
    than asked and a document never needs more than one task. Numbers depend on
    where an event lies, so they are written once: a task that runs again finds
    its events under the same numbers.
    """
    if not 1 <= size <= MAX_EVENTS:
        raise ValueError(f"size must be between 1 and {MAX_EVENTS}, got {size!r}")
    numbered = written(payload.select("value", F.floor(F.monotonically_increasing_id() / size).alias("batch_id")), "envelopes")
    joined = F.array_join(F.collect_list("value"), ",")
    return numbered.groupBy("batch_id").agg(F.concat(F.lit('{"events":['), joined, F.lit("]}")).alias("value"))
