"""Dashboard reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from . import inputs as I
from .registry import query

_DAY = 1440
_SINCE = f"started_at >= TIMESTAMP '{I.AS_OF}' - INTERVAL {_DAY} MINUTES"
_RECENT = f"{I.LOGS_SQL}, recent AS (SELECT * FROM logs WHERE {_SINCE})"


def _avg(x):
    return f"coalesce(round(avg({x})), 0)::INTEGER"


def _pct(q):
    """Interpolated percentile, rounded half to even.

    Written out as ``low + (high - low) * fraction``, the formula whose rounding
    of exact halves is wanted; the built-in function weighs both sides instead.
    """
    rank, values = f"({q}::DOUBLE * (count(latency_ms) - 1))", "list_sort(list(latency_ms))"
    low, high = f"{values}[(floor({rank}) + 1)::INT]", f"{values}[(ceil({rank}) + 1)::INT]"
    return f"coalesce(round_even({low} + ({high} - {low}) * ({rank} - floor({rank})), 0), 0)::INTEGER"


def _count(status):
    return f"count(*) FILTER (WHERE status = '{status}')"


_COST = "coalesce(sum(estimated_cost_usd::DECIMAL(18, 6)), 0)::DOUBLE"
_TOKENS = "coalesce(sum(total_tokens), 0)::BIGINT"
_SUMMARY_SQL = f"""count(*) AS total_requests, {_count('success')} AS success, {_count('error')} AS errors,
  {_count('cancelled')} AS cancelled, {_avg('latency_ms')} AS avg_latency_ms, {_pct(0.5)} AS p50_latency_ms,
  {_pct(0.95)} AS p95_latency_ms, {_pct(0.99)} AS p99_latency_ms, {_avg('ttft_ms')} AS avg_ttft_ms,
  {_TOKENS} AS total_tokens, {_COST} AS total_cost_usd"""
_MODEL_SQL = f"""provider, model, count(*) AS requests, {_count('error')} AS errors, {_avg('latency_ms')} AS avg_latency_ms,
  {_TOKENS} AS tokens, {_COST} AS cost_usd"""
_SERIES_SQL = f"""count(*) AS requests, {_count('error')} AS errors, {_count('cancelled')} AS cancelled,
  {_avg('latency_ms')} AS avg_latency_ms, {_pct(0.95)} AS p95_latency_ms, {_TOKENS} AS tokens"""


def _bucket(seconds):
    return f"make_timestamp((floor(epoch(started_at) / {seconds}) * {seconds} * 1000000)::BIGINT)"


def _logs(spark, sf):
    return I.stored_logs(spark, sf)


@query("h0_window", f"WITH {_RECENT} SELECT request_id, started_at FROM recent")
def _(spark, sf):
    return M.in_window(_logs(spark, sf), _DAY, I.AS_OF).select("request_id", "started_at")


@query("h1_summary", f"WITH {_RECENT} SELECT {_SUMMARY_SQL} FROM recent")
def _(spark, sf):
    return M.summary(_logs(spark, sf), _DAY, I.AS_OF)


@query("h1_summary_empty", f"WITH {I.LOGS_SQL} SELECT {_SUMMARY_SQL} FROM logs WHERE started_at >= TIMESTAMP '2030-01-01 00:00:00'")
def _(spark, sf):
    return M.summary(_logs(spark, sf), 60, "2030-01-01 01:00:00")


@query("h2_status_counts", f"WITH {I.LOGS_SQL} SELECT model, {_count('success')} AS success, {_count('error')} AS errors, {_count('cancelled')} AS cancelled FROM logs GROUP BY 1")
def _(spark, sf):
    return _logs(spark, sf).groupBy("model").agg(*M.status_counts())


@query("h3_percentiles", f"WITH {I.LOGS_SQL} SELECT model, {_pct(0.5)} AS p50_latency_ms, {_pct(0.95)} AS p95_latency_ms, {_pct(0.99)} AS p99_latency_ms FROM logs GROUP BY 1")
def _(spark, sf):
    folded = M.fold(M.latency_profile(_logs(spark, sf), ["model"]), ["model"])
    return folded.select("model", "p50_latency_ms", "p95_latency_ms", "p99_latency_ms")


@query("h4_averages", f"WITH {I.LOGS_SQL} SELECT status, {_avg('latency_ms')} AS avg_latency_ms, {_avg('ttft_ms')} AS avg_ttft_ms FROM logs GROUP BY 1")
def _(spark, sf):
    folded = M.fold(M.latency_profile(_logs(spark, sf), ["status"]), ["status"])
    return folded.select("status", "avg_latency_ms", "avg_ttft_ms")


@query("h5_by_model", f"WITH {_RECENT} SELECT {_MODEL_SQL} FROM recent GROUP BY provider, model")
def _(spark, sf):
    return M.by_model(_logs(spark, sf), _DAY, I.AS_OF)


def _listed(column, fields, separator="|"):
    """An array of structs as text, one line per element."""
    parts = lambda m: F.concat_ws(separator, *[m[f].cast("string") for f in fields])
    return F.array_join(F.transform(column, parts), "\n")


@query("h6_summary_payload", f"""WITH {_RECENT}, models AS (SELECT {_MODEL_SQL} FROM recent GROUP BY provider, model)
SELECT {_DAY} AS window_minutes, {_SUMMARY_SQL}, (SELECT string_agg(concat_ws('|', provider, model, requests, errors, avg_latency_ms, tokens),
  chr(10) ORDER BY requests DESC, provider, model) FROM models) AS by_model FROM recent""")
def _(spark, sf):
    payload = M.summary_payload(_logs(spark, sf), _DAY, I.AS_OF)
    fields = ("provider", "model", "requests", "errors", "avg_latency_ms", "tokens")
    return payload.withColumn("by_model", _listed("by_model", fields))


@query("h7_timeseries", f"WITH {_RECENT} SELECT {_bucket(1800)} AS bucket, {_SERIES_SQL} FROM recent GROUP BY 1")
def _(spark, sf):
    return M.timeseries(_logs(spark, sf), _DAY, 1800, I.AS_OF)


@query("h7_timeseries_all", f"WITH {I.LOGS_SQL} SELECT {_bucket(420)} AS bucket, {_SERIES_SQL} FROM logs GROUP BY 1")
def _(spark, sf):
    profile = M.latency_profile(_logs(spark, sf), [M.bucket_start(420).alias("bucket")])
    return M.fold_series(profile)


@query("h8_presets", f"WITH {I.LOGS_SQL} " + " UNION ALL ".join(
    f"SELECT '{label}' AS preset, {_bucket(bucket)} AS bucket, {_SERIES_SQL} FROM logs "
    f"WHERE started_at >= TIMESTAMP '{I.AS_OF}' - INTERVAL {minutes} MINUTES GROUP BY 2"
    for label, minutes, bucket in (("15m", 15, 60), ("1h", 60, 60), ("6h", 360, 300), ("24h", 1440, 1800))
))
def _(spark, sf):
    return M.dashboard_series(_logs(spark, sf), I.AS_OF)


_TYPES = f"""types AS (SELECT coalesce(error_type, 'unknown') AS error_type, n AS "count" FROM
  (SELECT error_type, count(*) AS n FROM recent WHERE status = 'error' GROUP BY error_type))"""
_LATEST = """SELECT request_id, provider, model, error_type, error_message, started_at FROM recent
  WHERE status = 'error' ORDER BY started_at DESC, request_id LIMIT 20"""


@query("h9_errors_by_type", f"WITH {_RECENT}, {_TYPES} SELECT * FROM types")
def _(spark, sf):
    return M.errors_by_type(_logs(spark, sf), _DAY, I.AS_OF)


@query("h10_recent_errors", f"WITH {_RECENT} {_LATEST}")
def _(spark, sf):
    return M.recent_errors(_logs(spark, sf), _DAY, I.AS_OF)


@query("h11_errors_payload", f"""WITH {_RECENT}, {_TYPES}, latest AS ({_LATEST})
SELECT {_DAY} AS window_minutes, (SELECT string_agg(error_type || '|' || "count", chr(10) ORDER BY "count" DESC, error_type) FROM types) AS by_type,
  (SELECT string_agg(concat_ws('|', request_id, provider, model, error_type, error_message), chr(10) ORDER BY started_at DESC, request_id) FROM latest) AS recent""")
def _(spark, sf):
    payload = M.errors_payload(_logs(spark, sf), _DAY, I.AS_OF)
    fields = ("request_id", "provider", "model", "error_type", "error_message")
    return payload.withColumns(
        {"by_type": _listed("by_type", ("error_type", "count")), "recent": _listed("recent", fields)}
    )


@query("h12_recent_logs", f"WITH {I.LOGS_SQL} SELECT {', '.join(M.LISTING)} FROM logs ORDER BY started_at DESC, request_id LIMIT 50")
def _(spark, sf):
    return M.recent_logs(_logs(spark, sf))


@query("h12_recent_logs_by_status", f"WITH {I.LOGS_SQL} SELECT {', '.join(M.LISTING)} FROM logs WHERE status = 'cancelled' ORDER BY started_at DESC, request_id LIMIT 200")
def _(spark, sf):
    return M.recent_logs(_logs(spark, sf), 200, status="cancelled")
