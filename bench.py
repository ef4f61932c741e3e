"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` names the input, ``BENCH_CPUS`` the local cores. Each query runs to a sink
that takes every row; the first run of the session warms the JVM and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from stormlift.plans import QUERIES

HEADLINES = [
    "features_v3",
    "features_v4",
    "ctx_counts",
    "gain_risk_curve",
    "gain_risk_by_airport",
    "curve_comparison",
    "best_theta",
    "airport_overview",
    "alert_overview",
    "describe_numeric",
    "corr_matrix",
    "hist_dist",
    "pivot_month_airport",
    "binary_metrics",
    "metrics_by_airport",
    "f1_grid_200",
    "model_table",
    "group_kfold",
    "alert_sessions",
    "train_lr",
    "stream_decisions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINES

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("airport_overview")
    timings = {name: round(run(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
