"""

Demand is ``lineitem`` once per copy, with its own supplier ids per copy; metadata is ``supplier``;
weather is one row per supplier nation and hour found in ``lineitem``.  Boosted trees are fitted if their number is given.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from loadcurve.functions.times import as_timestamp  # noqa: E402
from loadcurve.operators.diagnostics import join_success, key_coverage, range_alignment  # noqa: E402
from loadcurve.operators.joins import join_metadata  # noqa: E402
from loadcurve.operators.projections import numeric_columns  # noqa: E402
from loadcurve.operators.regression import (  # noqa: E402
    assemble, evaluate, fit_boosted_trees, fit_linear, score, split_by_time, split_point,
)
from loadcurve.plans.features import build_features  # noqa: E402
from loadcurve.plans.merge import located_ranges, merge_readings  # noqa: E402
from loadcurve.session import pin_utc, scratch_path, stored  # noqa: E402
from loadcurve.sources.sinks import read_back, write_partitioned, write_table  # noqa: E402


def inputs(spark: SparkSession, sf_dir: str, copies: int):
    lines, suppliers = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "supplier"))
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    stamp = (F.col("l_shipdate") + F.make_dt_interval(hours=F.pmod("l_linenumber", F.lit(24)))).alias("timestamp")
    unique_id = (F.col("s_suppkey") + F.col("copy") * 1_000_000).alias("unique_id")
    metadata = suppliers.select("*", copy.alias("copy")).select(
        unique_id, F.col("s_nationkey").cast("string").alias("location_id"),
        F.col("s_name").alias("building_class"), F.col("s_acctbal").alias("cluster_size"),
    )
    demand = lines.select("*", copy.alias("copy")).select(
        (F.col("l_suppkey") + F.col("copy") * 1_000_000).alias("unique_id"), stamp, F.col("l_extendedprice").alias("y")
    )
    weather = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").cast("string").alias("location_id"), stamp,
        F.col("l_quantity").alias("temperature_2m"), F.col("l_discount").alias("precipitation"), F.col("l_tax").alias("wind_speed_10m"),
    )
    stored = []
    for name, df in (("demand", demand), ("metadata", metadata), ("weather", weather)):
        path = scratch_path(spark, f"bench-{name}")
        df.repartition(16).write.parquet(path)
        stored.append(spark.read.parquet(path))
    return as_timestamp(stored[0]), stored[1], as_timestamp(stored[2])


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 10
    trees = int(sys.argv[2]) if len(sys.argv) > 2 else 0
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(4 * int(cpus)))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    pin_utc(spark)
    demand, metadata, weather = inputs(spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), copies)
    rows = demand.count()
    seconds: dict[str, float] = {}

    def timed(stage: str, work):
        started = time.perf_counter()
        result = work()
        seconds[stage] = round(time.perf_counter() - started, 2)
        return result

    timed("metadata_join_and_count", lambda: join_metadata(demand, metadata).count())
    timed("location_coverage", lambda: key_coverage(located_ranges(demand, metadata), weather).collect())
    timed("range_alignment", lambda: range_alignment(located_ranges(demand, metadata), weather).collect())
    merged_path, features_path = scratch_path(spark, "bench-merged"), scratch_path(spark, "bench-features")
    timed("merge_and_write", lambda: write_table(merge_readings(demand, metadata, weather), merged_path))
    merged = read_back(spark, merged_path)
    timed("join_success", lambda: join_success(merged).collect())
    timed("features_and_partitioned_write", lambda: write_partitioned(build_features(merged), features_path))
    features = read_back(spark, features_path)
    feature_rows = timed("read_back_count", features.count)
    timed("time_range", lambda: split_point(features))
    train, test = split_by_time(assemble(features, numeric_columns(features)))
    model = timed("linear_fit", lambda: fit_linear(train))
    metrics = timed("linear_evaluate", lambda: evaluate(score(model, test)).collect())
    if trees:
        kept = timed("training_rows_stored", lambda: stored(train))
        boosted = timed("boosted_fit", lambda: fit_boosted_trees(kept, max_iter=trees))
        metrics += timed("boosted_evaluate", lambda: evaluate(score(boosted, test)).collect())
    print(
        json.dumps(
            {
                "rows": rows,
                "feature_rows": feature_rows,
                "features": len(numeric_columns(features)),
                "rmse": [round(m.rmse, 4) for m in metrics],
                "seconds": seconds,
                "rows_per_sec": {k: round(rows / v) for k, v in seconds.items() if v},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
