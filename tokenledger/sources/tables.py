"""Table scans and small dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

# Fixed values: (provider, model, label) in order of preference.
CATALOG: tuple[tuple[str, str, str], ...] = (
    ("openai", "gpt-4o-mini", "GPT-4o mini"),
    ("openai", "gpt-4.1-mini", "GPT-4.1 mini"),
    ("openai", "gpt-4.1", "GPT-4.1"),
    ("anthropic", "claude-sonnet-4-5", "Claude Sonnet 4.5"),
    ("mock", "mock-1", "Mock model (offline)"),
)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CONVERSATIONS).parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MESSAGES).parquet(path)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CAPTURES).parquet(path)


def read_capture_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CAPTURE_CHUNKS).parquet(path)


def model_catalog(spark: SparkSession) -> DataFrame:
    """``(position, provider, model, label)`` as inline rows of known size."""
    rows = ", ".join(
        f"({i}, '{p}', '{m}', '{label}')" for i, (p, m, label) in enumerate(CATALOG)
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS catalog(position, provider, model, label)")


def available_models(catalog: DataFrame, providers: Sequence[str]) -> DataFrame:
    """Models of the enabled providers, the first entry per model name."""
    enabled = catalog.filter(F.col("provider").isin(list(providers)))
    first = F.min_by(F.struct("position", "provider", "label"), "position").alias("_first")
    return enabled.groupBy("model").agg(first).select(
        "_first.position", "_first.provider", "model", "_first.label"
    )


def default_model(available: DataFrame) -> DataFrame:
    """The first available model that is not the offline one, else the last."""
    return (
        available.withColumn("_offline", F.col("provider") == "mock")
        .orderBy("_offline", F.when(F.col("_offline"), -F.col("position")).otherwise(F.col("position")))
        .limit(1)
        .drop("_offline")
    )


def split_by_model(
    requests: DataFrame, available: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Requests for an available model (with its provider), and the others."""
    models = available.select("model", F.col("provider").alias("_provider"))
    accepted = (
        requests.drop("provider").join(models, "model").withColumnRenamed("_provider", "provider")
    )
    return accepted, requests.join(models, "model", "left_anti")
