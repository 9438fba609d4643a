"""Time series over a log stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import bucket_start, fold_series, latency_profile


def start_rollup(
    logs: DataFrame, path: str, checkpoint: str, bucket_seconds: int = 60, trigger: dict | None = None
) -> StreamingQuery:
    """Write the latency profile of every micro-batch to ``path/batch_id=N``.

    The stream keeps no state: profiles add up, so late events reach their
    bucket however late they are, and percentiles stay exact. A repeated
    micro-batch replaces its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latency_profile(batch, [bucket_start(bucket_seconds).alias("bucket")]).write.mode(
            "overwrite"
        ).parquet(f"{path}/batch_id={batch_id}")

    return (
        logs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The time series over all profiles written so far."""
    profile = spark.read.option("basePath", path).parquet(path).drop("batch_id")
    return fold_series(profile).orderBy("bucket")


def live_profile(
    logs: DataFrame, bucket_seconds: int = 60, watermark: str | None = None
) -> DataFrame:
    """The latency profile as a stateful streaming aggregation.

    State is one row of counters per bucket and latency, so a busy bucket is
    spread over all state partitions. Without a watermark late events always
    count and state grows with the number of buckets; a watermark bounds the
    state and drops later events.
    """
    if watermark is not None:
        logs = logs.withWatermark("started_at", watermark)
    window = F.window("started_at", f"{bucket_seconds} seconds").alias("_w")
    return latency_profile(logs, [window]).withColumn("bucket", F.col("_w.start")).drop("_w")


def start_live_series(
    logs: DataFrame,
    path: str,
    checkpoint: str,
    bucket_seconds: int = 60,
    trigger: dict | None = None,
    watermark: str | None = None,
) -> StreamingQuery:
    """Write the counters that every trigger changes to ``path/batch_id=N``.

    A trigger writes rows of the buckets and latencies it changed and nothing else,
    each with all that was counted so far, so the last one of a bucket and latency
    holds. A repeated trigger replaces its own folder. With a watermark, buckets
    behind it leave the state and later events for them are dropped.
    """
    return (
        live_profile(logs, bucket_seconds, watermark)
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_live_series(spark: SparkSession, path: str) -> DataFrame:
    """The time series over the last counters of every bucket and latency."""
    rows = spark.read.option("basePath", path).parquet(path)
    counters = [c for c in rows.columns if c not in ("bucket", "latency_ms", "batch_id")]
    last = rows.groupBy("bucket", "latency_ms").agg(F.max_by(F.struct(*counters), "batch_id").alias("_last"))
    return fold_series(last.select("bucket", "latency_ms", "_last.*")).orderBy("bucket")
