"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import ALL_QUERIES  # noqa: E402
from checks.fixtures import Tables  # noqa: E402

# Each query with the table whose rows it mainly works through.
HEADLINE = {
    "flagship_demand_by_class_and_hour": "events",
    "a01_hourly_resample": "events",
    "a02_target_stats": "events",
    "a03_weather_stats": "lineitem",
    "a07_missing_values": "orders",
    "a08_duplicate_summary": "events",
    "a09_first_weather_row": "events",
    "a14_completeness_per_location": "lineitem",
    "a16_averages_in_one_pass": "events",
    "a22_boxplot_by_class": "events",
    "a23_histogram": "events",
    "d01_key_coverage": "lineitem",
    "d02_range_alignment": "lineitem",
    "d03_join_success": "lineitem",
    "d05_unmatched_audit": "lineitem",
    "j01_readings_with_metadata": "events",
    "j02_readings_with_weather": "events",
    "l04_top_sources_and_other": "documents",
    "m02_sampled_series": "events",
    "w01_gaps": "events",
    "w02_rolling_stats": "events",
    "w02_rolling_stats_in_hours": "events",
    "w03_intervals_per_series": "events",
    "w04_first_row_per_key": "lineitem",
    "x02_correlation_matrix": "lineitem",
    "x04_demand_weather_correlation": "lineitem",
    "x08_scored_test_rows": "lineitem",
    "x09_error_metrics": "lineitem",
    "x07_boosted_trees": "orders",
    "q1_merged_table": "orders",
    "q2_feature_table": "orders",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, sf_dir)
    rows = {name: tables.raw(name).count() for name in sorted(set(HEADLINE.values()))}
    ALL_QUERIES["flagship_demand_by_class_and_hour"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up

    seconds, rate = {}, {}
    for name, table in HEADLINE.items():
        started = time.perf_counter()
        ALL_QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        rate[name] = round(rows[table] / seconds[name])
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "rows_per_sec": rate,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
