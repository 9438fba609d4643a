"""Compute derived columns once, however they are used afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same rows, with ``columns`` behind a generator of one row.

    Catalyst pushes a filter on a derived column below the projection by
    inserting the column's definition. For a chain of projections that each use
    the one before several times, the inserted expression grows exponentially.
    Filters stop at a generator.
    """
    others = [c for c in df.columns if c not in columns]
    once = F.inline(F.array(F.struct(*columns)))
    return df.select(*others, once).select(*df.columns)
