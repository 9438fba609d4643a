"""Skew-safe ordering against plain Python on keys of very different size."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tokenledger.operators import conversations as C
from tokenledger.operators import metrics as M
from tokenledger.operators.ordering import over_last_rows, with_position

BASE = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for key, n in (("hot", 400), ("warm", 30), ("one", 1)):
        for i in range(n):
            out.append((key, f"{key}-{i:04d}", BASE + timedelta(seconds=rng.randrange(90_000)), rng.choice("uuae"), f"t{i}"))
    return out


def _ordered(rows, keep=lambda r: True):
    groups = {}
    for r in sorted((r for r in rows if keep(r)), key=lambda r: (r[0], r[2], r[1])):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, id string, at timestamp, kind string, text string")


def test_positions(frame, rows):
    got = {r.id: r.position for r in with_position(frame, ["k"], "at", ["id"], parts=5).collect()}
    assert got == {r[1]: i for g in _ordered(rows).values() for i, r in enumerate(g)}


def test_a_hot_key_at_one_time_spreads_over_tasks(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 2000)).alias("k"),
        F.lit(BASE).alias("at"), F.xxhash64("id").alias("id"), F.lit("x" * 50).alias("position_"),
    ).withColumn("k", F.when(F.col("id") % 50 != 0, F.col("k")))
    placed = with_position(rows, ["k"], "at", ["id"], parts=24)
    tasks = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 60_000 and max(tasks) <= 2 * sorted(tasks)[len(tasks) // 2]
    keys = placed.groupBy("k").agg(F.count("*").alias("n"), F.min("position").alias("a"), F.max("position").alias("b"), F.countDistinct("position").alias("d"))
    assert keys.filter("a <> 0 or b <> n - 1 or d <> n").count() == 0
    before = placed.alias("x").join(placed.alias("y"), F.expr("x.k <=> y.k and x.position + 1 = y.position"))
    assert before.filter("x.id >= y.id").count() == 0
    assert with_position(rows.limit(0), ["k"], "at").count() == 0


@pytest.mark.parametrize("width", [1, 4, 7])
def test_last_rows_across_blocks(frame, rows, width):
    placed = with_position(frame, ["k"], "at", ["id"])
    out = over_last_rows(placed, ["k"], "position", width, {"w": lambda: F.collect_list("text")}, block_rows=7)
    got = {r.id: r.w for r in out.collect()}
    want = {r[1]: [x[4] for x in g[max(0, i - width + 1): i + 1]] for g in _ordered(rows).values() for i, r in enumerate(g)}
    assert got == want


def test_contexts_and_pages(spark, rows):
    roles, status = {"u": "user", "a": "assistant", "e": "assistant"}, {"e": "error"}
    messages = spark.createDataFrame(
        [(r[1], r[0], roles[r[3]], r[4], status.get(r[3], "complete"), None, None, None, r[2]) for r in rows],
        "id string, conversation_id string, role string, content string, status string, request_id string, "
        "prompt_tokens int, completion_tokens int, created_at timestamp",
    )
    conversations = spark.createDataFrame(
        [("hot", "be kind"), ("warm", None), ("one", ""), ("none", None)], "id string, system_prompt string"
    )
    contexts = C.turn_contexts(conversations, messages, limit=12, default_prompt="default")
    got = {r.message_id: [m.content for m in r.context] for r in contexts.collect()}
    want = {}
    for key, g in _ordered(rows, lambda r: r[3] != "e").items():
        for i, r in enumerate(g):
            if r[3] == "u":
                want[r[1]] = [{"hot": "be kind"}.get(key, "default")] + [x[4] for x in g[max(0, i - 11): i + 1]]
    assert got == want

    pages = C.conversation_detail(conversations, messages, page_rows=150).collect()
    sizes = sorted((r.id, r.page, len(r.messages)) for r in pages)
    assert sizes == [("hot", 0, 150), ("hot", 1, 150), ("hot", 2, 100), ("none", 0, 0), ("one", 0, 1), ("warm", 0, 30)]
    hot = [m.id for r in sorted((r for r in pages if r.id == "hot"), key=lambda r: r.page) for m in r.messages]
    assert hot == [r[1] for r in _ordered(rows)["hot"]]

    every = C.recent_messages(messages, 2000).collect()
    assert [m.id for m in every if m.conversation_id == "hot"] == [r[1] for r in _ordered(rows, lambda r: r[3] != "e")["hot"]]
    assert C.turn_contexts(conversations, messages, limit=5000).count() == len(want)

    recent = C.recent_messages(messages, 5).collect()
    assert [m.id for m in recent if m.conversation_id == "hot"] == [r[1] for r in _ordered(rows, lambda r: r[3] != "e")["hot"][-5:]]


def test_percentiles_interpolate_and_round_half_even(spark):
    logs = spark.createDataFrame([(x,) for x in (1, 2, 2, 3)], "latency_ms int").selectExpr(
        "latency_ms", "'success' AS status", "CAST(NULL AS INT) AS ttft_ms", "CAST(NULL AS INT) AS total_tokens",
        "CAST(NULL AS DOUBLE) AS estimated_cost_usd")
    row = M.fold(M.latency_profile(logs)).first()
    assert (row.requests, row.p50_latency_ms, row.p95_latency_ms, row.avg_latency_ms, row.tokens, row.cost_usd) == (4, 2, 3, 2, 0, 0.0)
    half = M.fold(M.latency_profile(logs.filter("latency_ms <> 1").dropDuplicates(["latency_ms"])))
    # Between 2 and 3: the half goes to the even side.
    assert half.first().p50_latency_ms == 2


@pytest.mark.parametrize("call", [lambda l: M.in_window(l, 0), lambda l: M.in_window(l, 1441), lambda l: M.timeseries(l, 60, 9), lambda l: M.recent_logs(l, 201)])
def test_bounds(frame, call):
    logs = frame.withColumnRenamed("at", "started_at")
    with pytest.raises(ValueError):
        call(logs)
