"""Which events to keep at high volume."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FRACTION = 2.0**-53  # 53 bits of a hash as a number in [0, 1)


class Sampler(ABC):
    @abstractmethod
    def keep(self, events: DataFrame) -> Column:
        """Boolean column: true for events to keep."""


@dataclass(frozen=True)
class KeepAll(Sampler):
    def keep(self, events: DataFrame) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Probability(Sampler):
    """Keep each event with the same probability.

    The decision hangs on a hash of the request id instead of a random number,
    so a task that runs again decides alike.
    """

    rate: float

    def __post_init__(self):
        if not 0.0 <= self.rate <= 1.0:
            raise ValueError(f"rate must be in [0, 1], got {self.rate!r}")

    def keep(self, events: DataFrame) -> Column:
        place = F.shiftrightunsigned(F.xxhash64("request_id"), 11).cast("double") * F.lit(_FRACTION)
        return place < F.lit(self.rate)


@dataclass(frozen=True)
class AlwaysKeepErrors(Sampler):
    """Errors and cancelled calls always pass; others go to the inner sampler."""

    inner: Sampler

    def keep(self, events: DataFrame) -> Column:
        return F.col("status").isin("error", "cancelled") | self.inner.keep(events)


@dataclass(frozen=True)
class CustomSampler(Sampler):
    """A boolean column, or a Python function from event to bool.

    An event for which the predicate is null or raises is kept. The function is
    called with a dict, in which nulls are None and whole numbers int, and runs
    over Arrow batches.
    """

    predicate: Column | Callable[[dict], bool]

    def keep(self, events: DataFrame) -> Column:
        if isinstance(self.predicate, Column):
            return F.coalesce(self.predicate, F.lit(True))
        fn = self.predicate

        def decide(event: dict) -> bool:
            try:
                return bool(fn(event))
            except Exception:
                return True

        @F.arrow_udf("boolean")
        def run(events: pa.Array) -> pa.Array:
            return pa.array([decide(e) for e in events.to_pylist()], pa.bool_())

        return run(F.struct(*[F.col(c) for c in events.columns]))


def sample(events: DataFrame, sampler: Sampler) -> DataFrame:
    return events.filter(sampler.keep(events))


def drop_ledger(events: DataFrame, sampler: Sampler) -> DataFrame:
    """Number of events the sampler drops, by reason."""
    return (
        events.filter(~sampler.keep(events))
        .groupBy(F.lit("sampled").alias("reason"))
        .agg(F.count(F.lit(1)).alias("dropped"))
    )
