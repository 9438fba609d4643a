"""Event sources: batch envelopes and single-event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json as J
from ..operators.validate import validate

MAX_BATCH = 500

#: Ids of at most this many batches may be broadcast.
BROADCAST_BATCHES = 100_000


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Batch files, one ``{"events": [...]}`` document each."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("batch_id"), "value"
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Files with one JSON event per line."""
    return spark.read.text(path)


def stream_events(
    spark: SparkSession, path: str, files_per_trigger: int = 50
) -> DataFrame:
    """The same files as a stream; offsets live in the query's checkpoint."""
    return (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )


def stream_kafka(
    spark: SparkSession, servers: str, topic: str, per_trigger: int = 500_000
) -> DataFrame:
    """Events from a Kafka topic (needs Spark's Kafka connector)."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", per_trigger)
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )


def stamp(df: DataFrame, at: Column | None = None) -> DataFrame:
    """One arrival time for the whole batch, whatever the producer sent."""
    return df.withColumn("received_at", F.current_timestamp() if at is None else at)


def explode_envelopes(envelopes: DataFrame) -> DataFrame:
    """One row per event: ``batch_id``, ``pos`` (0-based) and JSON ``value``.

    An envelope without a list of events, or with an empty one, yields a single
    row with null ``pos`` so that the batch is not lost.
    """
    events = J.strict_fields(F.col("value"), "events: array<variant>")["events"]
    return envelopes.select("batch_id", F.posexplode_outer(events)).select(
        "batch_id", F.col("pos").cast("long").alias("pos"), F.to_json("col").alias("value")
    )


def judge_batches(events: DataFrame) -> DataFrame:
    """Verdict per batch: size, number of bad events, accepted or not.

    ``events`` comes from :func:`explode_envelopes`, validated or not. Counting is
    combined before the shuffle, so a huge batch costs one row per input partition.
    """
    checked = events if "error" in events.columns else validate(events)
    return checked.groupBy("batch_id").agg(
        F.count("pos").alias("events"),
        F.count_if(F.col("pos").isNotNull() & F.col("error").isNotNull()).alias("invalid"),
    ).select(
        "batch_id", "events", "invalid",
        (F.col("events").between(1, MAX_BATCH) & (F.col("invalid") == 0)).alias("accepted"),
    )


def accepted_events(events: DataFrame, count_first: bool = False) -> DataFrame:
    """Events of batches that are valid as a whole.

    Positions of 500 and more exist only in batches that are too large and are
    left out before the join, so no batch brings more than 500 rows to it. Spark
    expects far too few batches, so they are shuffled and never broadcast, unless
    ``count_first``, for events that are cheap to read again, finds that the accepted
    ones or the others are few.
    """
    verdicts = judge_batches(events)
    small = events.filter(F.col("pos") < MAX_BATCH)
    good = verdicts.filter("accepted").select("batch_id")
    if count_first:
        refused = ~F.col("accepted") & (F.col("events") > 0)
        found = verdicts.agg(F.count_if("accepted").alias("good"), F.count_if(refused).alias("bad")).first()
        if found.bad <= min(found.good, BROADCAST_BATCHES):
            bad = F.broadcast(verdicts.filter(refused).select("batch_id"))
            return small.filter(F.col("batch_id").isNotNull()).join(bad, "batch_id", "left_anti")
        if found.good <= BROADCAST_BATCHES:
            return small.join(F.broadcast(good), "batch_id", "left_semi")
    return small.join(good.hint("shuffle_hash"), "batch_id", "left_semi")
