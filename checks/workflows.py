"""The composed plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.aggregates import HOURLY_SQL, box_sql, completeness_sql, other_sql
from checks.fixtures import DAILY_TIES, Tables
from checks.joins import LOST
from checks.registry import check, rounded
from checks.statistics import STUMP, binary_lines
from checks.windows import last_rows, rolling_sql
from loadcurve.operators import rolling, timeseries
from loadcurve.operators.joins import join_metadata
from loadcurve.plans import completeness, features, merge, profiling, resampling, training
from loadcurve.session import scratch_path
from loadcurve.sources.sinks import read_back, write_partitioned, write_table

FLAGSHIP_SQL = """, h AS (SELECT unique_id, date_trunc('hour', "timestamp") AS "timestamp", sum(y) AS y FROM readings GROUP BY 1, 2)
    SELECT m.building_class, CAST(hour(h."timestamp") AS INTEGER) AS hour, count(*) AS n_hours, round(avg(h.y), 4) AS avg_demand
    FROM h LEFT JOIN metadata m ON h.unique_id = m.unique_id GROUP BY 1, 2"""


@check("flagship_demand_by_class_and_hour", FLAGSHIP_SQL)
def flagship(t: Tables):
    """Hourly demand joined to metadata, averaged by class and hour of day."""
    hourly = join_metadata(timeseries.resample(t.readings), t.metadata, ["building_class"])
    by_hour = hourly.groupBy("building_class", F.hour("timestamp").alias("hour"))
    return rounded(by_hour.agg(F.count(F.lit(1)).alias("n_hours"), F.avg("y").alias("avg_demand")), 4, "avg_demand")


def _written_sources(t: Tables) -> dict[str, str]:
    """The roles as stored tables, as the file-to-file plans expect them."""
    paths = {name: scratch_path(t.spark, name) for name in ("demand", "metadata", "weather")}
    write_table(t.orders_demand, paths["demand"], inputs=[t.dir])
    write_table(t.metadata, paths["metadata"], inputs=[t.dir])
    write_table(t.daily_raw, paths["weather"], inputs=[t.dir])
    return paths


@check("q1_merged_table", "SELECT * FROM merged")
def _(t: Tables):
    paths = _written_sources(t)
    reports = merge.run_merge(
        t.spark, paths["demand"], paths["metadata"], paths["weather"], scratch_path(t.spark, "merged"), weather_order=DAILY_TIES
    )
    return reports["merged"].select(*t.merged.columns)


@check(
    "q1_merge_coverage",
    """, l AS (SELECT DISTINCT location_id FROM merged), r AS (SELECT DISTINCT location_id FROM daily),
        c AS (SELECT (SELECT count(*) FROM l) AS n_left, (SELECT count(*) FROM r) AS n_right,
                     (SELECT count(*) FROM l JOIN r ON l.location_id = r.location_id) AS n_common,
                     (SELECT count(*) FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.location_id = l.location_id)) AS n_left_only)
       SELECT *, round(100.0 * n_left_only / n_left, 4) AS left_only_pct FROM c""",
)
def _(t: Tables):
    reports = merge.merge_diagnostics(t.orders_demand, t.metadata, t.daily_raw, t.merged)
    return rounded(reports["coverage"], 4)


@check(
    "q1_merge_success",
    """, c AS (SELECT count(*) AS n_rows, count(location_id) AS n_located,
                      count(*) FILTER (location_id IS NOT NULL AND temperature_2m IS NULL) AS n_located_unmatched,
                      count(*) FILTER (temperature_2m IS NULL) AS n_unmatched FROM merged)
       SELECT *, round(100.0 * n_located_unmatched / n_located, 4) AS located_unmatched_pct,
              round(100.0 * n_unmatched / n_rows, 4) AS unmatched_pct FROM c""",
)
def _(t: Tables):
    paths = _written_sources(t)
    target = scratch_path(t.spark, "merged")
    reports = merge.run_merge(t.spark, paths["demand"], paths["metadata"], paths["weather"], target, weather_order=DAILY_TIES)
    return rounded(reports["success"], 4)


FEATURES_SQL = (
    ", f AS (" + rolling_sql("merged", '"timestamp", o_orderkey', 3, rolling.FEATURE_WINDOWS, last_rows,
    """, o_orderkey, location_id, building_class, cluster_size, temperature_2m, relative_humidity_2m, precipitation, wind_speed_10m,
    CAST(year("timestamp") AS INTEGER) AS year, CAST(month("timestamp") AS INTEGER) AS month, CAST(day("timestamp") AS INTEGER) AS day,
    CAST(dayofweek("timestamp") + 1 AS INTEGER) AS dayofweek, CAST(dayofyear("timestamp") AS INTEGER) AS dayofyear,
    CAST(hour("timestamp") AS INTEGER) AS hour""")
    + ") SELECT * FROM f WHERE y IS NOT NULL AND y_rolling_mean_168h IS NOT NULL"
)
ROLLED = [f"y_rolling_{s}_{n}h" for n in rolling.FEATURE_WINDOWS for s in ("mean", "stddev")]


@check("q2_feature_table", FEATURES_SQL)
def _(t: Tables):
    source, target = scratch_path(t.spark, "merged"), scratch_path(t.spark, "features")
    write_table(t.merged, source, inputs=[t.dir])
    return rounded(features.run_features(t.spark, source, target, tiebreak=["o_orderkey"]), 3, *ROLLED)


def _metrics_hold(rows: list[dict], t: Tables) -> bool:
    return (
        sorted(r["prediction"] for r in rows) == ["boosted", "linear"]
        and len({r["n"] for r in rows}) == 1 and all(0 <= r["mae"] <= r["rmse"] for r in rows)
    )


@check("q3_model_metrics", holds=_metrics_hold)
def _(t: Tables):
    # the features pass over the merged rows twice, training over its features many times, so both are read from storage
    source, path = scratch_path(t.spark, "merged"), scratch_path(t.spark, "features")
    write_table(t.merged.drop("location_id"), source, inputs=[t.dir])
    built = features.build_features(read_back(t.spark, source), tiebreak=["o_orderkey"])
    write_partitioned(built.drop("o_orderkey"), path, inputs=[t.dir])
    return rounded(training.train_and_evaluate(read_back(t.spark, path)).metrics, 4)


@check(
    "q3_metrics_on_binary_feature",
    STUMP + """SELECT unnest(['linear', 'boosted']) AS prediction, n, rmse, mae FROM (
        SELECT count(*) AS n, round(sqrt(avg(power(prediction - y, 2))), 3) AS rmse, round(avg(abs(prediction - y)), 3) AS mae FROM s)""",
)
def _(t: Tables):
    # with a 0/1 feature both models predict the class means
    return rounded(training.train_and_evaluate(binary_lines(t), ["x"], max_iter=1, max_depth=1).metrics, 3)


@check(
    "q4_demand_counts",
    """, c AS (SELECT count(*) AS n_rows, count(y) AS n_valid, count(*) FILTER (y IS NULL) AS n_null,
                      count(*) FILTER (y <= 0) AS n_non_positive FROM readings)
       SELECT *, round(100.0 * n_null / n_rows, 4) AS null_pct, round(100.0 * n_non_positive / n_valid, 4) AS non_positive_pct FROM c""",
)
def _(t: Tables):
    return rounded(profiling.profile_demand(t.readings)["counts"], 4)


@check("q4_top_locations", other_sql("metadata", "location", 15))
def _(t: Tables):
    return profiling.profile_metadata(t.metadata)["top_location"]


@check(
    "q4_demand_by_dataset",
    """, x AS (SELECT r.y, m.dataset FROM readings r LEFT JOIN metadata m ON r.unique_id = m.unique_id)
       SELECT dataset, 'y' AS "column", count(y) AS count, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS stddev, round(min(y), 4) AS min,
         round(quantile_cont(y, 0.25), 4) AS q25, round(quantile_cont(y, 0.5), 4) AS q50, round(quantile_cont(y, 0.75), 4) AS q75,
         round(max(y), 4) AS max FROM x GROUP BY 1""",
)
def _(t: Tables):
    return rounded(profiling.profile_relations(t.readings, t.metadata, t.weather)["by_dataset"], 4)


@check(
    "q4_box_by_dataset",
    """, x AS (SELECT r.y, coalesce(m.dataset, 'Missing') AS dataset FROM readings r LEFT JOIN metadata m ON r.unique_id = m.unique_id) """
    + box_sql("x", "dataset", "y", 4),
)
def _(t: Tables):
    return rounded(profiling.profile_relations(t.readings, t.metadata, t.weather)["box_by_dataset"], 4)


@check(
    "q4_weather_correlation",
    """, x AS (SELECT d.y, w.temperature_2m FROM demand d JOIN metadata m ON d.unique_id = m.unique_id
            JOIN weather w ON w.location_id = m.location_id AND w."timestamp" = date_trunc('hour', d."timestamp") WHERE d.y IS NOT NULL)
       SELECT 'temperature_2m' AS measure, round(corr(y, temperature_2m), 6) AS r FROM x""",
)
def _(t: Tables):
    return rounded(profiling.profile_relations(t.demand, t.metadata, t.weather)["weather_correlation"], 6)


@check(
    "q4_weather_intervals",
    """, g AS (SELECT epoch("timestamp") - epoch(lag("timestamp") OVER (PARTITION BY location_id ORDER BY "timestamp")) AS s FROM weather)
       SELECT CAST(s AS BIGINT) AS diff_seconds, count(*) AS count FROM g WHERE s IS NOT NULL GROUP BY 1 ORDER BY count DESC, diff_seconds LIMIT 10""",
)
def _(t: Tables):
    return profiling.profile_weather(t.weather.withColumn("precipitation", F.col("temperature_2m")))["intervals"]


@check(
    "q5_weather_completeness",
    completeness_sql("daily", 86400) + "SELECT *, round(100.0 * actual_records / expected_records, 4) AS completeness_pct FROM q",
)
def _(t: Tables):
    return rounded(completeness.audit_weather(t.daily_raw, t.merged, step_seconds=86400)["per_location"], 4)


@check(
    "q5_unmatched_readings",
    LOST + """SELECT l.*, EXISTS (SELECT 1 FROM daily_raw w WHERE w.location_id = l.location_id AND w."timestamp" = l."timestamp") AS in_weather
              FROM lost l""",
)
def _(t: Tables):
    return completeness.audit_weather(t.daily_raw, t.merged, step_seconds=86400)["unmatched"]


@check("q6_resampled_table", HOURLY_SQL)
def _(t: Tables):
    source, target = scratch_path(t.spark, "readings"), scratch_path(t.spark, "hourly")
    write_table(t.readings, source, inputs=[t.dir])
    return rounded(resampling.run_resampling(t.spark, source, target)[0], 5, "y")
