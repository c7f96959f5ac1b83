"""Time the headline queries; print one JSON line.

BENCH_SF_DIR   folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline queries)

Each query is built and written to a no-op sink, so every row and column is computed but
none is sent to Python. A query runs twice and the faster run counts; the first one pays
for code generation and the JVM's warm-up.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tickerloom.plans.queries import QUERIES

HEADLINE = [
    "bars_scan",
    "bars_resample_day",
    "bars_resample_hour",
    "latest_price",
    "parse_tickers",
    "cik_dim",
    "facts_flatten",
    "facts_named",
    "simple_returns",
    "sma_14",
    "rsi_series",
    "rsi_series_intraday",
    "rsi_latest",
    "ma_cross",
    "rsi_accuracy",
    "rsi_turnover",
    "ci_distance",
    "penny_filter",
    "beta",
    "facts_dedup",
    "latest_annual",
    "concept_fallback",
    "factor_record",
    "snapshot",
    "run_counts",
    "sort_ci",
    "topk_ci",
    "screen_targets",
    "report_view",
    "search_list",
    "universe_create",
    "universe_refresh",
]


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tickerloom-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = session(cpus)
    times = {
        name: round(min(seconds(spark, name, sf_dir) for _ in range(2)), 3)
        for name in names
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
