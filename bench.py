"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local threads, ``BENCH_QUERIES`` a
comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from stratalake.queries import all_queries

HEADLINE = [
    "bronze_csv",
    "bronze_json_lines",
    "bronze_overwrite",
    "bronze_append_evolve",
    "bronze_incremental",
    "bronze_compaction",
    "bronze_two_writers",
    "stream_files",
    "silver_step",
    "silver_pk_filter",
    "silver_incremental",
    "silver_upsert",
    "gold_revenue",
    "gold_left_expr",
    "gold_two_step",
    "gold_spread",
    "gold_full_using",
    "gold_star",
    "gold_plan",
    "gold_plan_eager",
    "gold_many_to_many",
    "gold_distinct_sets",
    "gold_incremental",
    "gold_ratio",
    "gold_count_distinct",
    "gold_case_rate",
    "gold_auto_summary",
    "gold_from_names",
    "key_audit",
    "key_coverage",
    "catalog_tables",
    "catalog_statistics",
    "sql_join_semi_anti",
    "sql_window_rank",
    "sql_cube",
    "sql_topk",
    "medallion_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> None:
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("gold_revenue")  # starts the JVM's machinery; not timed
    times = {}
    for name in names:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
