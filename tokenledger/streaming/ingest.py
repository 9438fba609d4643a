"""Continuous ingest from an event stream into the log store."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.redact import Redactor
from ..operators.process import check, to_rows
from ..operators.validate import validate
from ..sources.bronze import accepted_events, explode_envelopes, stamp
from ..sources.store import LogStore


def ingest_batch(
    bronze: DataFrame,
    store: LogStore,
    batch_id: int,
    prices: DataFrame | None = None,
    redact_again: bool = False,
    redactor: Redactor = Redactor(),
) -> None:
    """Validate, enrich and store one batch; bad events go to the dead letters.

    Every table is written to folders named after the batch, so calling this
    again with the same id after a failure replaces what was written.
    """
    now = F.lit(datetime.now(timezone.utc))
    _store(to_rows(check(bronze, prices, redact_again, redactor).checked, now), store, batch_id)


def _store(checked: DataFrame, store: LogStore, batch_id: int) -> None:
    """What :func:`ingest_batch` does with rows of :func:`to_rows`."""
    # Checked once and written: later reads take the columns they need, in splits of
    # files, whose size does not depend on how much a task of the source held.
    with store.staged(checked, batch_id) as rows:
        counts = rows.agg(
            F.count(F.lit(1)).alias("received"), F.count_if(~F.col("_good")).alias("parked")
        ).first()
        good = rows.filter("_good").drop("_dead", "_good")
        stored = store.append_staged(good, batch_id, known_rows=counts.received - counts.parked)
        store.park(rows.filter(~F.col("_good")).select("_dead.*"), batch_id)
        store.note(batch_id, counts.received, counts.parked, stored)


def ingest_envelopes(envelopes: DataFrame, store: LogStore, batch_id: int, at: Column | None = None, **options) -> None:
    """Store the events of the envelopes that are valid as a whole, all with one
    arrival time; the other envelopes are refused. Every event is validated once,
    for its envelope's verdict and for its own row, and written until it is judged.
    ``options`` are those of :func:`ingest_batch`."""
    now = F.lit(datetime.now(timezone.utc))
    checked = check(validate(stamp(explode_envelopes(envelopes), at)), **options).checked
    invalid = F.when(F.col("stage") == "validation", F.col("error")).alias("error")
    rows = to_rows(checked, now, F.col("batch_id"), invalid)
    # What is invalid refuses its envelope and so becomes no dead letter.
    rows = rows.withColumn("_dead", F.when(F.col("error").isNull(), F.col("_dead")))
    with store.held(rows, batch_id, "arrived") as events:
        _store(accepted_events(events, count_first=True).drop("batch_id", "error"), store, batch_id)


def start_ingest(
    events: DataFrame,
    store: LogStore,
    checkpoint: str,
    redact_again: bool = False,
    redactor: Redactor = Redactor(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run :func:`ingest_batch` for every micro-batch of a stream.

    Committing a micro-batch to the checkpoint is the acknowledgement; until
    then it is delivered again. The default trigger handles what is there and
    stops.
    """
    return (
        events.writeStream.foreachBatch(
            lambda batch, batch_id: ingest_batch(
                batch, store, batch_id, redact_again=redact_again, redactor=redactor
            )
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


class FirstSeen(StatefulProcessor):
    """Passes the first row of a key and none for as long as the key is remembered."""

    def __init__(self, order: tuple[str, ...], ttl_ms: int | None):
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "met boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            # Nulls first, as in a sort.
            yield min(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order])
            self.seen.update((True,))

    def close(self) -> None:
        pass


#: Groups that a micro-batch is cut into by the hash of its keys. A task holds the keys of one.
KEY_GROUPS = 1 << 14


def _place(row: tuple) -> list:
    """Nulls first, as in a sort."""
    return [(v is not None, tuple(v.values()) if isinstance(v, dict) else v) for v in row]


def _first_in_group(order: tuple[str, ...], key: str):
    """The first row in ``order`` of every key of a group, read batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        kept: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            names = batch.column_names
            rows = zip(batch.column(names.index(key)).to_pylist(), *[batch.column(names.index(c)).to_pylist() for c in order])
            ahead: dict = {}
            for i, (k, *at) in enumerate(rows):
                at = _place(at)
                if k not in best or at < best[k][0]:
                    best[k] = (at, n)
                    ahead[k] = i
            if ahead:
                taken = batch.take(pa.array(ahead.values(), pa.int64()))
                for i, k in enumerate(ahead):
                    best[k] = (best[k][0], n + i)
                kept.append(taken)
                n += taken.num_rows
                if n > 2 * len(best) + 10_000:  # rows that a later one came before
                    kept, n = [_taken(kept, best)], len(best)
                    best = {k: (at, i) for i, (k, (at, _)) in enumerate(best.items())}
        if best:
            yield _taken(kept, best)

    def _taken(kept: list[pa.RecordBatch], best: dict) -> pa.RecordBatch:
        whole = pa.Table.from_batches(kept).take(pa.array([i for _, i in best.values()], pa.int64()))
        return whole.combine_chunks().to_batches()[0]

    return run


def first_in_stream(events: DataFrame, order: Sequence[str], key: str = "request_id", remember: timedelta | None = None) -> DataFrame:
    """First event per request across a whole stream, by keyed state.

    Within a micro-batch the first in ``order`` counts, across them the one that
    came first. State is one flag per key on disk, found by key, so a micro-batch
    costs what it holds and not what came before it. Copies inside a micro-batch are
    taken out group by group in Arrow batches, and Spark's own keyed state does the rest;
    a checkpoint of the state that ``remember`` uses doesn't fit it. ``remember`` frees a key that
    long after it was met (by the clock); without it keys stay for good. Keys must
    not be null. Rows pass through Python, with ``remember`` key by key; the columns should be few.
    """
    if remember is not None:
        ttl = int(remember.total_seconds() * 1000)
        return events.groupBy(key).transformWithState(FirstSeen(tuple(order), ttl), events.schema, "append", "processingTime")
    group = F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS)).alias("_group")
    first = events.groupBy(group).applyInArrow(_first_in_group(tuple(order), key), events.schema)
    return first.dropDuplicates([key])


def dedupe_in_stream(events: DataFrame, delay: str, time: str = "received_at") -> DataFrame:
    """First event per request within a bounded time; older keys leave the state.

    Redeliveries later than ``delay`` pass, so the store's exact check stays in
    place behind it.
    """
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["request_id"])


def gauges(bronze: DataFrame, store: LogStore) -> DataFrame:
    """``stream_depth`` (all events ever published), ``pending`` (not handled
    yet) and ``dlq_depth``. Handled counts come from the per-batch ledger."""
    published = bronze.agg(F.count(F.lit(1)).alias("stream_depth"), F.lit(1).alias("_one"))
    handled = store.ledger().agg(
        F.coalesce(F.sum("received"), F.lit(0)).alias("_received"),
        F.coalesce(F.sum("parked"), F.lit(0)).alias("dlq_depth"),
        F.lit(1).alias("_one"),
    )
    return published.join(handled, "_one").select(
        "stream_depth", (F.col("stream_depth") - F.col("_received")).alias("pending"), "dlq_depth"
    )
