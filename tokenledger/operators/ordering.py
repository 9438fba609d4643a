"""Positions and sliding windows inside keys of any size.

A plain window partitioned by the key puts the whole key into one task. These
helpers cut every key along its order first, so a key that holds a large part of
all rows is spread over many tasks, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def _parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int) -> DataFrame:
    """The rows cut into ``parts`` runs of one global order, written.

    Adds ``_part`` and ``_at``, which grows along the order. Rows are cut by all of
    the order, so a key that holds most rows, even at one time, reaches over many
    parts of like size.
    """
    cut = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    fixed = written(cut.withColumn("_at", F.monotonically_increasing_id()), "positions")
    return fixed.withColumn("_part", F.shiftright("_at", 33).cast("int"))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, parts: int | None = None
) -> DataFrame:
    """Add the sum of ``value``, a count, over the rows of a key before this one.

    Rows are cut into parts of one global order, values are added up per part and
    key, and a key's sums along its parts, of which it has at most all. Inside a
    part rows are added up in order and shifted by what came before. Only the key
    a part begins with can have rows in an earlier one, so at most one shift per
    part is broadcast. Null keys are a key; nulls come first in the order; rows
    that are equal in it follow each other in any order.
    """
    if parts is None:
        parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _parts(df.withColumn("_value", value), keys, order, parts)
    sums = rows.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        F.col("_part").alias("_in"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.sum("_sum").over(earlier).alias("_start")
    ).filter(F.col("_start") > 0)
    # A part goes to the reducer of its number as it is.
    inside = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.repartitionById(parts, "_part").withColumn("_before", F.sum("_value").over(inside))
    same = F.col("_part") == F.col("_in")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    zero = F.lit(0).cast("long")
    return placed.join(F.broadcast(carried), same, "left").select(
        *df.columns, (F.coalesce("_start", zero) + F.coalesce("_before", zero)).alias(name)
    )


def with_position(
    df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str] = (), name: str = "position", parts: int | None = None
) -> DataFrame:
    """Add the 0-based position of a row in its key, ordered by time and ties."""
    return running_sum(df, keys, (time, *ties), F.lit(1).cast("long"), name, parts)


def over_last_rows(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    rows: int,
    values: dict[str, Callable[[], Column]],
    block_rows: int = 4096,
) -> DataFrame:
    """Aggregates over the current and the ``rows - 1`` preceding rows of a key.

    ``values`` maps an output name to a function returning the aggregate. Keys
    are cut into blocks of consecutive positions. The last ``rows - 1`` rows of
    a block are copied into the next one, where they only serve as predecessors.
    """
    if rows < 1:
        raise ValueError(f"rows must be at least 1, got {rows!r}")
    block_rows = max(block_rows, 2 * rows)
    block = F.col(position) - F.col(position) % block_rows
    is_tail = F.col(position) % block_rows >= block_rows - (rows - 1)
    placed = df.withColumn("_own", block).withColumn(
        "_block",
        F.explode(
            F.when(is_tail, F.array(F.col("_own"), F.col("_own") + block_rows)).otherwise(
                F.array(F.col("_own"))
            )
        ),
    )
    w = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(-(rows - 1), 0)
    return (
        placed.withColumns({n: make().over(w) for n, make in values.items()})
        .filter(F.col("_own") == F.col("_block"))
        .drop("_own", "_block")
    )
