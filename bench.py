"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the input folder, BENCH_CPUS the number of local cores. Every
query is run once to warm up and then BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

import pyspark

from tokenledger.plans import load
from tokenledger.session import local_session

HEADLINE = (
    "h1_summary", "h5_by_model", "h6_summary_payload", "h7_timeseries", "h7_timeseries_all",
    "h9_errors_by_type", "h12_recent_logs", "d1_redact", "a6_first_wins", "b13_log_rows",
    "i1_list", "i6_turn_contexts", "e20_events",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench", cpus)
    registry = load().QUERIES
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    rows = {
        t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
        for t in ("events", "documents", "conversations")
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "rows": rows,
                "cpus": cpus,
                "spark": pyspark.__version__,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
