"""Every registered query against its SQL counterpart on the smallest data."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import compare

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    result = compare(spark, SF, name, QUERIES[name], ORACLES.get(name))
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_known_summary_values(spark):
    row = QUERIES["h1_summary"](spark, SF).first()
    assert (row.total_requests, row.errors, row.cancelled) == (40, 7, 2)
    assert (row.avg_latency_ms, row.p50_latency_ms, row.p95_latency_ms, row.p99_latency_ms) == (545, 442, 1159, 1533)
    assert (row.avg_ttft_ms, row.total_tokens, row.total_cost_usd) == (340, 21440, 0.076812)
