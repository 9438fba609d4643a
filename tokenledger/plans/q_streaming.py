"""Streaming queries: run over all input, then read what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.emit import emit, to_envelopes
from ..operators.metrics import summary
from ..session import shared_dir
from ..sources.bronze import stream_events
from ..sources.store import LogStore
from ..streaming import ingest as N
from ..streaming import series as R
from . import inputs as I
from .q_ingest import _INVALID, _REFUSED
from .q_capture import _EVENT_SQL
from .q_capture import _events as captured
from .q_metrics import _DAY, _RECENT, _SERIES_SQL, _SUMMARY_SQL, _bucket
from .registry import query


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = I.table(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 50)
        .parquet(sf_dir)
    )


def _finish(streaming_query) -> None:
    streaming_query.awaitTermination()


@query("a2_event_stream", f"WITH {I.RAW_LOGS_SQL} SELECT request_id FROM raw")
def _(spark, sf):
    root = shared_dir(spark, "landing")
    I.events_json(spark, sf).select("value").write.text(f"{root}/in")
    _finish(
        stream_events(spark, f"{root}/in")
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{root}/out")
    )
    doc = F.try_parse_json("value")
    return spark.read.parquet(f"{root}/out").select(
        F.try_variant_get(doc, "$.request_id", "string").alias("request_id")
    )


def _ingested(spark, sf, damaged):
    root = shared_dir(spark, "ingest")
    store = LogStore(spark, f"{root}/store")
    sent = I.shape_events(event_stream(spark, sf), damaged).select("value")
    _finish(N.start_ingest(sent, store, f"{root}/checkpoint"))
    return store


@query("j1_ingest_stream", f"""WITH {I.RAW_LOGS_SQL} SELECT request_id, 'stored' AS outcome FROM raw WHERE event_id % 50 NOT IN {_INVALID} AND event_id % 50 NOT IN {_REFUSED}
UNION ALL SELECT NULL, CASE WHEN event_id % 50 IN {_REFUSED} THEN 'processing' ELSE 'validation' END FROM raw WHERE event_id % 50 IN {_INVALID} OR event_id % 50 IN {_REFUSED}""")
def _(spark, sf):
    store = _ingested(spark, sf, True)
    stored = store.logs().select("request_id", F.lit("stored").alias("outcome"))
    parked = store.dead_letters().select(F.lit(None).cast("string").alias("request_id"), F.col("stage").alias("outcome"))
    return stored.unionByName(parked)


@query("j2_stream_dedupe", f"WITH {I.RAW_LOGS_SQL} SELECT request_id FROM raw")
def _(spark, sf):
    root = shared_dir(spark, "dedupe")
    logs = I.shape_logs(event_stream(spark, sf))
    copies = logs.withColumn("_copy", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))))
    unique = N.dedupe_in_stream(copies.drop("_copy"), "40 days", "started_at")
    _finish(
        unique.select("request_id").writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{root}/out")
    )
    return spark.read.parquet(f"{root}/out")


@query("j2_keyed_state", f"WITH {I.RAW_LOGS_SQL} SELECT request_id, 0 AS copy FROM raw")
def _(spark, sf):
    """Every third event comes three times; keyed state passes the first copy, also in a second run."""
    root = shared_dir(spark, "keyed")
    logs = I.shape_logs(event_stream(spark, sf)).select("request_id", F.explode(F.sequence(F.when(F.col("event_id") % 3 == 0, 2).otherwise(0), F.lit(0), F.lit(-1))).alias("copy"))
    for _ in range(2):
        _finish(
            N.first_in_stream(logs, ["copy"]).writeStream.format("parquet")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{root}/out")
        )
    return spark.read.parquet(f"{root}/out")


_SERIES = f"WITH {I.LOGS_SQL} SELECT {_bucket(3600)} AS bucket, {_SERIES_SQL} FROM logs GROUP BY 1"


def _log_stream(spark, sf):
    return I.shape_stored(I.shape_logs(event_stream(spark, sf)))


@query("j3_rollup_series", _SERIES)
def _(spark, sf):
    root = shared_dir(spark, "rollup")
    _finish(R.start_rollup(_log_stream(spark, sf), f"{root}/profile", f"{root}/checkpoint", 3600))
    return R.read_rollup(spark, f"{root}/profile")


@query("j3_live_series", _SERIES)
def _(spark, sf):
    root = shared_dir(spark, "series")
    _finish(R.start_live_series(_log_stream(spark, sf), f"{root}/out", f"{root}/checkpoint", 3600))
    return R.read_live_series(spark, f"{root}/out")


@query("j4_gauges_behind", """SELECT count(*) AS stream_depth, count(*) FILTER (WHERE event_id % 4 = 3) AS pending, 0::BIGINT AS dlq_depth FROM events""")
def _(spark, sf):
    """A quarter of what was published has not been read yet."""
    store = LogStore(spark, shared_dir(spark, "behind"))
    events = I.events_json(spark, sf)
    N.ingest_batch(events.filter(F.col("event_id") % 4 != 3).select("value"), store, 0)
    return N.gauges(events, store)


@query("j4_gauges", f"""SELECT count(*) AS stream_depth, 0::BIGINT AS pending, count(*) FILTER (WHERE event_id % 50 IN {_INVALID} OR event_id % 50 IN {_REFUSED}) AS dlq_depth FROM events""")
def _(spark, sf):
    store = _ingested(spark, sf, True)
    return N.gauges(I.events_json(spark, sf, True), store)


@query("j3_store_series", _SERIES)
def _(spark, sf):
    """The stored series of a stream in which every third event comes twice."""
    root = shared_dir(spark, "stored-series")
    store = LogStore(spark, f"{root}/store")
    sent = I.shape_events(event_stream(spark, sf))
    twice = sent.withColumn("_copy", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3 == 0).cast("int"))))
    _finish(N.start_ingest(twice.select("value"), store, f"{root}/checkpoint"))
    return store.series(3600)


@query("j1_envelopes_to_store", f"""WITH {I.BATCHES_SQL}, good AS (SELECT batch_id FROM batched GROUP BY 1 HAVING count(*) <= 500), {I.RAW_LOGS_SQL}
SELECT request_id FROM raw JOIN batched USING (event_id) JOIN good USING (batch_id)""")
def _(spark, sf):
    store = LogStore(spark, shared_dir(spark, "envelopes"))
    N.ingest_envelopes(I.envelopes(spark, sf), store, 0)
    return store.logs().select("request_id")


@query("j1_captured_to_store", f"{_EVENT_SQL} SELECT request_id, status, provider, streaming AS streamed, total_tokens::INTEGER AS total_tokens, error_type FROM event")
def _(spark, sf):
    store = LogStore(spark, shared_dir(spark, "captured"))
    N.ingest_envelopes(to_envelopes(emit(captured(spark, sf))), store, 0)
    return store.logs().select("request_id", "status", "provider", "streamed", "total_tokens", "error_type")


@query("h1_stored_summary", f"WITH {_RECENT} SELECT {_SUMMARY_SQL} FROM recent")
def _(spark, sf):
    """The summary of the last day of a stored table; older dates are not read."""
    store = LogStore(spark, shared_dir(spark, "summary"))
    N.ingest_batch(I.events_json(spark, sf).select("value"), store, 0)
    return summary(store.logs(), _DAY, I.AS_OF)
