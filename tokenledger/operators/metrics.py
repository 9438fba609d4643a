"""Dashboard reads over the log table.

All aggregates go through a latency profile: one row per group and distinct
latency, holding plain counters. It is built by an ordinary hash aggregation
(combined before the shuffle, spread over all reducers) and is bounded by the
number of distinct whole-millisecond latencies. Exact percentiles are then read
off the running counts of the profile, so no task ever holds the latencies of a
whole group, however large the group is. Profiles of disjoint sets of logs add
up, which is what the streaming rollup stores.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT_ERRORS = 20

# Dashboard presets (label, window minutes, bucket seconds).
PRESETS: tuple[tuple[str, int, int], ...] = (
    ("15m", 15, 60),
    ("1h", 60, 60),
    ("6h", 360, 300),
    ("24h", 1440, 1800),
)

# Columns of the recent-log listing.
LISTING = (
    "request_id", "conversation_id", "service", "provider", "model", "status",
    "streamed", "latency_ms", "ttft_ms", "prompt_tokens", "completion_tokens",
    "total_tokens", "tokens_per_second", "estimated_cost_usd", "error_type",
    "error_message", "input_preview", "output_preview", "pii_redaction_count",
    "started_at", "processed_at",
)

AsOf = datetime | str | Column | None


def _bounded(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value!r}")
    return value


def _instant(as_of: AsOf) -> Column:
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def in_window(logs: DataFrame, window_minutes: int, as_of: AsOf = None) -> DataFrame:
    """Logs started within the last minutes; there is no upper bound.

    Where the table is partitioned by ``started_date`` the same bound prunes
    partitions.
    """
    minutes = _bounded("window_minutes", window_minutes, 1, 1440)
    since = _instant(as_of) - F.expr(f"INTERVAL {minutes} MINUTES")
    if "started_date" in logs.columns:
        logs = logs.filter(F.col("started_date") >= F.to_date(since))
    return logs.filter(F.col("started_at") >= since)


def status_counts() -> list[Column]:
    return [
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled"),
    ]


def latency_profile(logs: DataFrame, keys: Sequence[str | Column] = ()) -> DataFrame:
    """Counters per ``keys`` and distinct latency.

    Costs are summed as whole micro-dollars: they have six decimals, and integer
    sums do not depend on the order of addition.
    """
    micros = F.round(F.col("estimated_cost_usd") * 1_000_000).cast("long")
    return logs.groupBy(*keys, "latency_ms").agg(
        F.count(F.lit(1)).alias("requests"),
        *status_counts(),
        F.sum(F.col("ttft_ms").cast("long")).alias("ttft_sum"),
        F.count("ttft_ms").alias("ttft_count"),
        F.sum(F.col("total_tokens").cast("long")).alias("tokens"),
        F.sum(micros).alias("cost_micros"),
    )


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def _mean(total: Column, count: Column) -> Column:
    """Average rounded half away from zero, 0 when there is nothing."""
    return F.coalesce(F.round(F.try_divide(total, count)).cast("int"), F.lit(0))


_QUANTILES = (("p50_latency_ms", 0.5), ("p95_latency_ms", 0.95), ("p99_latency_ms", 0.99))


def fold(profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every measure of a profile per ``keys``; without keys exactly one row.

    A percentile is interpolated between the two latencies around its rank and
    rounded half to even. The ranks come from running counts over the profile,
    whose window shares the partitioning of the aggregation.
    """
    latency = F.col("latency_ms")
    weight = F.when(latency.isNotNull(), F.col("requests")).otherwise(F.lit(0))
    group = Window.partitionBy(*keys)
    so_far = group.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = profile.withColumns(
        {
            "_weight": weight,
            "_n": F.sum(weight).over(group),
            "_upto": F.sum(weight).over(so_far),
        }
    )

    def at(rank: Column) -> Column:
        here = (F.col("_upto") - F.col("_weight") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(here, latency))

    bounds = []
    for name, q in _QUANTILES:
        rank = F.lit(q) * (F.col("_n") - 1)
        bounds += [at(F.floor(rank)).alias(f"_lo_{name}"), at(F.ceil(rank)).alias(f"_hi_{name}")]
    folded = ranked.groupBy(*keys).agg(
        _total("requests").alias("requests"),
        _total("success").alias("success"),
        _total("errors").alias("errors"),
        _total("cancelled").alias("cancelled"),
        _mean(F.sum(latency.cast("long") * F.col("requests")), F.sum("_weight")).alias("avg_latency_ms"),
        F.max("_n").alias("_n"),
        *bounds,
        _mean(F.sum("ttft_sum"), F.sum("ttft_count")).alias("avg_ttft_ms"),
        _total("tokens").alias("tokens"),
        (_total("cost_micros") / F.lit(1e6)).alias("cost_usd"),
    )

    def between(name: str, q: float) -> Column:
        rank = F.lit(q) * (F.col("_n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        value = low + (high - low) * (rank - F.floor(rank))
        return F.coalesce(F.bround(value).cast("int"), F.lit(0))

    return folded.withColumns({n: between(n, q) for n, q in _QUANTILES}).drop(
        "_n", *[f"_{side}_{n}" for n, _ in _QUANTILES for side in ("lo", "hi")]
    )


_SUMMARY = {
    "total_requests": "requests", "success": "success", "errors": "errors",
    "cancelled": "cancelled", "avg_latency_ms": "avg_latency_ms",
    "p50_latency_ms": "p50_latency_ms", "p95_latency_ms": "p95_latency_ms",
    "p99_latency_ms": "p99_latency_ms", "avg_ttft_ms": "avg_ttft_ms",
    "total_tokens": "tokens", "total_cost_usd": "cost_usd",
}
_BY_MODEL = ("provider", "model", "requests", "errors", "avg_latency_ms", "tokens", "cost_usd")


def summary(logs: DataFrame, window_minutes: int = 60, as_of: AsOf = None) -> DataFrame:
    """Totals of the window, always one row, zeros when it is empty."""
    profile = latency_profile(in_window(logs, window_minutes, as_of))
    return fold(profile).select(*[F.col(c).alias(n) for n, c in _SUMMARY.items()])


def by_model(logs: DataFrame, window_minutes: int = 60, as_of: AsOf = None) -> DataFrame:
    """Requests, errors, latency, tokens and cost per model, most used first."""
    # No percentiles here: a plain aggregation is enough.
    micros = F.round(F.col("estimated_cost_usd") * 1_000_000).cast("long")
    return (
        in_window(logs, window_minutes, as_of)
        .groupBy("provider", "model")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(F.col("status") == "error").alias("errors"),
            _mean(F.sum(F.col("latency_ms").cast("long")), F.count("latency_ms")).alias("avg_latency_ms"),
            F.coalesce(F.sum(F.col("total_tokens").cast("long")), F.lit(0)).alias("tokens"),
            (F.coalesce(F.sum(micros), F.lit(0)) / F.lit(1e6)).alias("cost_usd"),
        )
        .orderBy(F.desc("requests"), "provider", "model")
    )


def summary_payload(logs: DataFrame, window_minutes: int = 60, as_of: AsOf = None) -> DataFrame:
    """The summary with the per-model breakdown nested in ``by_model``.

    Both come from one scan: the profile is kept per model, and its few rows
    count once for their model and once for the grand total.
    """
    profile = latency_profile(in_window(logs, window_minutes, as_of), ["provider", "model"])
    nobody = F.lit(None).cast("string")
    scopes = F.array(
        F.struct(F.lit(0).alias("_level"), "provider", "model"),
        F.struct(F.lit(1).alias("_level"), nobody.alias("provider"), nobody.alias("model")),
    )
    counters = [c for c in profile.columns if c not in ("provider", "model")]
    both = profile.select(*counters, F.inline(scopes))
    measured = fold(both, ["_level", "provider", "model"])
    is_total = F.col("_level") > 0
    total = F.struct(*[F.col(c).alias(n) for n, c in _SUMMARY.items()])
    model = F.struct((-F.col("requests")).alias("_rank"), *_BY_MODEL)
    nested = measured.agg(
        F.first(F.when(is_total, total), ignorenulls=True).alias("_total"),
        F.array_sort(F.collect_list(F.when(~is_total, model))).alias("_models"),
    )
    return nested.select(
        F.lit(window_minutes).alias("window_minutes"),
        *[F.coalesce(F.col(f"_total.{n}"), F.lit(0)).alias(n) for n in _SUMMARY],
        F.transform("_models", lambda m: F.struct(*[m[c].alias(c) for c in _BY_MODEL])).alias("by_model"),
    )


def _side_by_side(*parts: DataFrame) -> DataFrame:
    """Single-row frames as one row, joined on a constant key."""
    first, *rest = [p.withColumn("_one", F.lit(1)) for p in parts]
    for other in rest:
        first = first.join(other, "_one")
    return first.drop("_one")


def bucket_start(bucket_seconds: int, time: str = "started_at") -> Column:
    """Start of the epoch-aligned bucket a timestamp falls in."""
    seconds = _bounded("bucket_seconds", bucket_seconds, 10, 3600)
    return F.window(time, f"{seconds} seconds")["start"]


_SERIES = ("requests", "errors", "cancelled", "avg_latency_ms", "p95_latency_ms", "tokens")


def fold_series(profile: DataFrame, keys: Sequence[str] = ("bucket",)) -> DataFrame:
    """Time series measures of a profile that is keyed by bucket."""
    return fold(profile, keys).select(*keys, *_SERIES)


def timeseries(
    logs: DataFrame, window_minutes: int = 60, bucket_seconds: int = 60, as_of: AsOf = None
) -> DataFrame:
    """Measures per tumbling bucket in time order; empty buckets are absent."""
    logs = in_window(logs, window_minutes, as_of)
    profile = latency_profile(logs, [bucket_start(bucket_seconds).alias("bucket")])
    return fold_series(profile).orderBy("bucket")


def dashboard_series(logs: DataFrame, as_of: AsOf = None, presets=PRESETS) -> DataFrame:
    """The time series of every dashboard preset from one scan.

    Rows of the longest window are assigned to the presets that reach back to
    them, at most one copy per preset.
    """
    now = _instant(as_of)
    options = F.array(
        *[
            F.struct(
                F.lit(label).alias("preset"),
                F.lit(_bounded("bucket_seconds", bucket, 10, 3600)).alias("bucket_seconds"),
                (now - F.expr(f"INTERVAL {int(minutes)} MINUTES")).alias("since"),
            )
            for label, minutes, bucket in presets
        ]
    )
    rows = in_window(logs, max(m for _, m, _ in presets), as_of)
    rows = rows.select(
        "latency_ms", "ttft_ms", "status", "total_tokens", "estimated_cost_usd", "started_at",
        F.explode(F.filter(options, lambda o: F.col("started_at") >= o["since"])).alias("_p"),
    )
    epoch = F.unix_seconds(F.col("started_at").cast("timestamp"))
    bucket = F.timestamp_seconds(F.floor(epoch / F.col("_p.bucket_seconds")) * F.col("_p.bucket_seconds"))
    profile = latency_profile(rows, [F.col("_p.preset").alias("preset"), bucket.alias("bucket")])
    return fold_series(profile, ["preset", "bucket"]).orderBy("preset", "bucket")


def errors_by_type(logs: DataFrame, window_minutes: int = 60, as_of: AsOf = None) -> DataFrame:
    """Error counts per type, most frequent first.

    Rows without a type and rows typed ``unknown`` stay two groups; both are
    labelled ``unknown``.
    """
    return (
        in_window(logs, window_minutes, as_of)
        .filter(F.col("status") == "error")
        .groupBy("error_type")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.coalesce("error_type", F.lit("unknown")).alias("error_type"), "count")
        .orderBy(F.desc("count"), "error_type")
    )


def recent_errors(logs: DataFrame, window_minutes: int = 60, as_of: AsOf = None) -> DataFrame:
    """The 20 latest errors of the window."""
    return (
        in_window(logs, window_minutes, as_of)
        .filter(F.col("status") == "error")
        .select("request_id", "provider", "model", "error_type", "error_message", "started_at")
        .orderBy(F.desc("started_at"), "request_id")
        .limit(RECENT_ERRORS)
    )


def errors_payload(logs: DataFrame, window_minutes: int = 60, as_of: AsOf = None) -> DataFrame:
    """Error counts by type and the latest errors as nested arrays of one row."""
    types = errors_by_type(logs, window_minutes, as_of)
    recent = recent_errors(logs, window_minutes, as_of)
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("count")).alias("_rank"), "error_type", "count"))
    )
    micros = -F.unix_micros(F.col("started_at").cast("timestamp"))
    latest = F.array_sort(
        F.collect_list(F.struct(micros.alias("_rank"), *recent.columns))
    )
    return _side_by_side(
        types.agg(
            F.lit(window_minutes).alias("window_minutes"),
            F.transform(
                ranked, lambda e: F.struct(e["error_type"].alias("error_type"), e["count"].alias("count"))
            ).alias("by_type"),
        ),
        recent.agg(
            F.transform(latest, lambda e: F.struct(*[e[c].alias(c) for c in recent.columns])).alias("recent")
        ),
    )


def recent_logs(
    logs: DataFrame, limit: int = 50, status: str | None = None, conversation_id: str | None = None
) -> DataFrame:
    """Latest logs, optionally of one status or conversation."""
    _bounded("limit", limit, 1, 200)
    if status is not None:
        logs = logs.filter(F.col("status") == status)
    if conversation_id is not None:
        logs = logs.filter(F.col("conversation_id") == conversation_id)
    return logs.select(*LISTING).orderBy(F.desc("started_at"), "request_id").limit(limit)
