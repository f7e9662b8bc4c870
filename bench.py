"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
``land`` is the one-off cost of computing the trip relation from the test tables and
``export`` that of building the six aggregate tables from it; the queries then read
trips or tables as they would on stored data. A small scan starts the session before
the clock; each query is run once to warm the JVM, then twice, and the faster run counts.
Every row is written to a no-op sink.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "g1_coverage_timeline",
    "g2_hourly_profile",
    "g3_incentive_breakdown",
    "g4_monthly_kpis",
    "g5_data_quality",
    "g6_market_share",
    "s7_archive",
    "q1_describe",
    "q10_cleaning_effect",
    "q11_funnel",
    "q16_monthly_volume",
    "q23_concentration",
    "q25_leadership",
    "q28_yearly_economics",
    "q31_direction_economics",
    "q42_latest_year_summary",
    "q45_lifetime_matrix",
    "q51_target_gaps",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("curbside-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="curbside-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from curbside.registry import QUERIES, source

    def seconds(action) -> float:
        start = time.perf_counter()
        action()
        return round(time.perf_counter() - start, 3)

    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg({"l_quantity": "sum"}).collect()
    times = {"land": seconds(lambda: source(spark, sf_dir))}
    times["export"] = seconds(lambda: source(spark, sf_dir).study.tables)
    for name in HEADLINE:
        run(name)
        times[name] = min(seconds(lambda: run(name)) for _ in range(2))
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(sf_dir).removeprefix("sf")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
