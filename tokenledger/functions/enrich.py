"""Columns derived from a validated event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import word_count

# List price in USD per million tokens, (input, output).
PRICES: dict[str, tuple[float, float]] = {
    "gpt-4.1": (2.00, 8.00),
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4o-mini": (0.15, 0.60),
    "claude-sonnet-4-5": (3.00, 15.00),
    "mock-1": (0.0, 0.0),
}


def pricing(spark: SparkSession) -> DataFrame:
    """Price table ``(model, input_rate, output_rate)``.

    Inline rows, so Catalyst knows the exact size and decides on the broadcast
    itself; a larger table of a user gets the same treatment.
    """
    rows = ", ".join(f"('{m}', {i}D, {o}D)" for m, (i, o) in PRICES.items())
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS prices(model, input_rate, output_rate)"
    )


def total_tokens(prompt: Column, completion: Column, reported: Column) -> Column:
    """The reported total, else the sum of both parts, else null."""
    return F.coalesce(reported.cast("long"), prompt.cast("long") + completion.cast("long"))


def tokens_per_second(completion: Column, latency_ms: Column) -> Column:
    """Two decimals; null when either input is null or zero."""
    return F.when(
        (completion > 0) & (latency_ms > 0),
        F.round(completion / (latency_ms / F.lit(1000)), 2),
    )


def cost(prompt: Column, completion: Column, input_rate: Column, output_rate: Column) -> Column:
    """USD with six decimals; null when a token count or a rate is null."""
    million = F.lit(1_000_000)
    return F.round(prompt / million * input_rate + completion / million * output_rate, 6)


def with_cost(df: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Add ``estimated_cost_usd`` by exact model name; unknown models get null."""
    prices = pricing(df.sparkSession) if prices is None else prices
    rates = prices.select(
        F.col("model").alias("_model"),
        F.col("input_rate").alias("_in"),
        F.col("output_rate").alias("_out"),
    )
    joined = df.join(rates, F.col("model") == F.col("_model"), "left")
    return joined.withColumn(
        "estimated_cost_usd",
        cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("_in"), F.col("_out")),
    ).drop("_model", "_in", "_out")


def enrich(df: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Token total, throughput and cost in one pass."""
    out = df.withColumns(
        {
            "total_tokens": total_tokens(
                F.col("prompt_tokens"), F.col("completion_tokens"), F.col("total_tokens")
            ),
            "tokens_per_second": tokens_per_second(
                F.col("completion_tokens"), F.col("latency_ms")
            ),
        }
    )
    return with_cost(out, prices)


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps, truncated."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("long")


def context_usage(messages: Column, reply: Column) -> Column:
    """Word-based token estimate for a message list and its reply."""
    prompt = F.aggregate(
        messages, F.lit(0).cast("long"), lambda acc, m: acc + word_count(m["content"])
    )
    completion = word_count(reply)
    return F.struct(
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"),
    )


def success_rate(success: Column, total: Column) -> Column:
    """Percentage of successes; 100 when there is nothing to rate."""
    return F.when(total > 0, success / total * 100).otherwise(F.lit(100.0))
