"""Sources, sinks, projections, filters and scalar functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks.fixtures import TABLE_NAMES, Tables
from checks.registry import check, rounded
from loadcurve.functions import scalars, times
from loadcurve.operators import filters, projections
from loadcurve.operators.topk import top_k
from loadcurve.session import scratch_path
from loadcurve.sources import sinks, tables


@check("s01_load_table", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(t: Tables):
    return tables.read_table(t.spark, t.path("events"), "ts")


@check("s02_timestamps_from_text", "SELECT event_id, ts FROM events")
def _(t: Tables):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return times.as_timestamp(t.raw("events").select("event_id", text.alias("ts")), "ts")


@check("s03_millisecond_rewrite", "SELECT * FROM orders")
def _(t: Tables):
    target = scratch_path(t.spark, "orders-millis")
    sinks.rewrite_with_millisecond_timestamps(t.spark, t.path("orders"), target, "o_orderdate")
    return sinks.read_back(t.spark, target)


@check("s04_checked_source", "SELECT unique_id, count(*) AS n_readings FROM readings GROUP BY unique_id")
def _(t: Tables):
    checked = tables.check_contract(t.readings, tables.DEMAND, require_rows=True)
    return checked.groupBy("unique_id").agg(F.count(F.lit(1)).alias("n_readings"))


@check("s05_written_table", 'SELECT unique_id, "timestamp", y FROM readings')
def _(t: Tables):
    target = scratch_path(t.spark, "readings")
    sinks.write_table(t.readings, target, inputs=[t.path("events")])
    return sinks.read_back(t.spark, target)


@check(
    "s06_partitioned_table",
    """SELECT unique_id, "timestamp", y, CAST(year("timestamp") AS INTEGER) AS year,
              CAST(month("timestamp") AS INTEGER) AS month FROM orders_demand""",
)
def _(t: Tables):
    target = scratch_path(t.spark, "orders-by-month")
    dated = t.orders_demand.select("unique_id", "timestamp", "y", F.year("timestamp").alias("year"), F.month("timestamp").alias("month"))
    sinks.write_partitioned(dated, target, inputs=[t.path("orders")])
    return sinks.read_back(t.spark, target)


def _by_month(t: Tables) -> str:
    target = scratch_path(t.spark, "orders-by-month")
    dated = t.orders_demand.select("unique_id", "timestamp", "y", F.year("timestamp").alias("year"), F.month("timestamp").alias("month"))
    sinks.write_partitioned(dated, target, inputs=[t.path("orders")])
    return target


@check(
    "s06_time_range",
    """SELECT unique_id, "timestamp", y FROM orders_demand
       WHERE "timestamp" >= TIMESTAMP '1996-03-10 00:00:00' AND "timestamp" < TIMESTAMP '1997-02-02 00:00:00'""",
)
def _(t: Tables):
    rows = sinks.read_time_range(t.spark, _by_month(t), datetime(1996, 3, 10), datetime(1997, 2, 2))
    return rows.select("unique_id", "timestamp", "y")


@check("s06_table_by_series", """SELECT unique_id, min("timestamp") AS first_ts, count(*) AS n_rows, count(y) AS n_valid FROM orders_demand GROUP BY 1""")
def _(t: Tables):
    path = scratch_path(t.spark, "orders-by-series")
    rows = sinks.write_by_series(t.orders_demand, path, path.rsplit("/", 1)[1].replace("-", "_"), buckets=8, inputs=[t.path("orders")])
    return rows.groupBy("unique_id").agg(
        F.min("timestamp").alias("first_ts"), F.count(F.lit(1)).alias("n_rows"), F.count("y").alias("n_valid")
    )


@check("s07_read_back_count", "SELECT count(*) AS n_rows FROM readings")
def _(t: Tables):
    target = scratch_path(t.spark, "readings")
    sinks.write_table(t.readings, target, inputs=[t.path("events")])
    return sinks.read_back(t.spark, target).agg(F.count(F.lit(1)).alias("n_rows"))


@check(
    "s08_table_profile",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "table", count(*) AS n_rows,
            (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {n})) AS n_cols FROM {n}"""
        for n in TABLE_NAMES
    ),
)
def _(t: Tables):
    return tables.table_profile({n: t.raw(n) for n in TABLE_NAMES})


@check("p01_pruned_columns", "SELECT unique_id, location_id, building_class, cluster_size FROM metadata")
def _(t: Tables):
    return projections.prune(t.metadata, ["unique_id", "location_id", "absent_column", "building_class", "cluster_size"])


@check(
    "p02_derived_columns",
    """SELECT unique_id, date_trunc('hour', "timestamp") AS timestamp_hour, y AS demand FROM readings""",
)
def _(t: Tables):
    return projections.derive(
        t.readings, {"timestamp_hour": times.truncate_to_hour("timestamp")}, {"y": "demand"}, ["timestamp"]
    )


@check(
    "p03_join_without_duplicate_columns",
    """SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_acctbal
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def _(t: Tables):
    orders = t.raw("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = t.raw("customer").select("c_custkey", "c_name", "c_acctbal")
    return projections.join_keep_left(orders, customers, [("o_custkey", "c_custkey")])


@check(
    "p04_numeric_columns",
    "SELECT cluster_size, temperature_2m, relative_humidity_2m, precipitation, wind_speed_10m, o_orderkey FROM merged",
)
def _(t: Tables):
    return t.merged.select(projections.numeric_columns(t.merged))


@check(
    "p05_calendar_labels",
    """SELECT strftime("timestamp", '%a') AS day_name,
              CASE WHEN isodow("timestamp") IS NULL THEN 0 ELSE CAST(isodow("timestamp") AS INTEGER) END AS display_position,
              strftime("timestamp", '%b') AS month_name, count(*) AS n
       FROM orders_demand GROUP BY ALL""",
)
def _(t: Tables):
    day = times.weekday_name(F.dayofweek("timestamp"))
    named = t.orders_demand.select(day.alias("day_name"), times.month_name(F.month("timestamp")).alias("month_name"))
    place = times.display_position("day_name", times.WEEKDAY_DISPLAY_ORDER).cast("int")
    return named.groupBy("day_name", place.alias("display_position"), "month_name").agg(F.count(F.lit(1)).alias("n"))


@check("f01_known_target", "SELECT * FROM readings WHERE y IS NOT NULL")
def _(t: Tables):
    return filters.with_target(t.readings)


ROLLED = """, rolled AS (
  SELECT unique_id, "timestamp", y,
    round(avg(y) OVER (PARTITION BY unique_id ORDER BY "timestamp" ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 5) AS y_rolling_mean_24h,
    count(*) OVER (PARTITION BY unique_id ORDER BY "timestamp" ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS y_rolling_rows_24h
  FROM readings) """


def _rolled(t: Tables):
    from loadcurve.operators.rolling import rolling_features

    return rounded(rolling_features(t.readings, windows=[24], stats=["mean", "rows"]), 5, "y_rolling_mean_24h")


@check("f02_initial_window_null_test", ROLLED + "SELECT * FROM rolled WHERE y_rolling_mean_24h IS NOT NULL")
def _(t: Tables):
    return filters.without_initial_window(_rolled(t), 24)


@check("f02_initial_window_full_frames", ROLLED + "SELECT * FROM rolled WHERE y_rolling_rows_24h >= 24")
def _(t: Tables):
    return filters.without_initial_window(_rolled(t), 24, mode="full")


@check("f03_known_keys", "SELECT * FROM metadata WHERE location_id IS NOT NULL AND location IS NOT NULL")
def _(t: Tables):
    return filters.with_keys(t.metadata, "location_id", "location")


@check(
    "f04_unparsable_timestamps",
    """SELECT count(*) AS n_rows, count(try_cast(s AS TIMESTAMP)) AS n_kept,
              count(*) - count(try_cast(s AS TIMESTAMP)) AS n_dropped
       FROM (SELECT CASE WHEN event_type = 'error' THEN 'n/a ' || event_type ELSE CAST(ts AS VARCHAR) END AS s FROM events)""",
)
def _(t: Tables):
    bad = F.col("event_type") == "error"
    text = F.when(bad, F.concat(F.lit("n/a "), F.col("event_type"))).otherwise(F.col("ts").cast("string"))
    return times.parse_report(t.raw("events").select(text.alias("timestamp")))


@check("f05_non_positive_values", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <= 0")
def _(t: Tables):
    return filters.non_positive(t.raw("customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@check("f05_negative_values", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def _(t: Tables):
    return filters.negative(t.raw("customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@check(
    "f06_rows_of_ids",
    "SELECT * FROM readings WHERE unique_id IN (SELECT unique_id FROM metadata WHERE building_class = 'BUILDING')",
)
def _(t: Tables):
    return filters.having_ids(t.readings, t.metadata.filter(F.col("building_class") == "BUILDING"))


@check("f06_rows_of_listed_classes", "SELECT * FROM metadata WHERE dataset IN ('ASIA', 'EUROPE')")
def _(t: Tables):
    return filters.having_ids(t.metadata, ["ASIA", "EUROPE"], "dataset")


@check(
    "f07_missing_weather_rows",
    """SELECT unique_id, "timestamp", location_id FROM merged
       WHERE temperature_2m IS NULL AND location_id IS NOT NULL AND location_id NOT IN ('None')""",
)
def _(t: Tables):
    lost = filters.missing_observation("temperature_2m", exclude=["None"])
    return t.merged.filter(lost).select("unique_id", "timestamp", "location_id")


@check("f09_complete_rows", "SELECT * FROM merged WHERE y IS NOT NULL AND temperature_2m IS NOT NULL AND location_id IS NOT NULL")
def _(t: Tables):
    return filters.complete_cases(t.merged, ["y", "temperature_2m", "location_id"])


@check("f09_rows_complete_in_all_columns", "SELECT * FROM metadata WHERE location_id IS NOT NULL AND location IS NOT NULL")
def _(t: Tables):
    return filters.complete_cases(t.metadata)


@check("f10_valid_for_log", "SELECT unique_id, location, cluster_size FROM metadata WHERE cluster_size >= 0 AND location IS NOT NULL")
def _(t: Tables):
    return t.metadata.filter(filters.valid_for_log("cluster_size", "location")).select("unique_id", "location", "cluster_size")


@check(
    "f11_rows_of_top_categories",
    """SELECT * FROM metadata WHERE location IN (
         SELECT location FROM metadata WHERE location IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, location LIMIT 5)""",
)
def _(t: Tables):
    counts = t.metadata.dropna(subset=["location"]).groupBy("location").count()
    return filters.in_top_categories(t.metadata, top_k(counts, 5, "count", ["location"]), "location")


@check(
    "e01_calendar_features",
    """SELECT unique_id, "timestamp", y,
         CAST(year("timestamp") AS INTEGER) AS year, CAST(month("timestamp") AS INTEGER) AS month,
         CAST(day("timestamp") AS INTEGER) AS day, CAST(dayofweek("timestamp") + 1 AS INTEGER) AS dayofweek,
         CAST(dayofyear("timestamp") AS INTEGER) AS dayofyear, CAST(hour("timestamp") AS INTEGER) AS hour
       FROM readings""",
)
def _(t: Tables):
    return times.calendar_features(t.readings)


@check("e02_hour_truncated", """SELECT unique_id, "timestamp", date_trunc('hour', "timestamp") AS timestamp_hour FROM readings""")
def _(t: Tables):
    return t.readings.select("unique_id", "timestamp", times.truncate_to_hour("timestamp").alias("timestamp_hour"))


@check("e03_epoch_seconds", """SELECT unique_id, "timestamp", CAST(floor(epoch_us("timestamp") / 1000000.0) AS BIGINT) AS seconds FROM readings""")
def _(t: Tables):
    return t.readings.select("unique_id", "timestamp", times.epoch_seconds("timestamp").alias("seconds"))


@check("e04_missing_flag", """SELECT unique_id, "timestamp", CASE WHEN y IS NULL THEN 'missing' ELSE 'present' END AS state FROM readings""")
def _(t: Tables):
    state = F.when(scalars.is_missing(t.readings, "y"), "missing").otherwise("present")
    return t.readings.select("unique_id", "timestamp", state.alias("state"))


@check(
    "e05_guarded_percent",
    """SELECT unique_id, round(100.0 * count(y) / NULLIF(count(*) FILTER (y > 300), 0), 4) AS pct FROM readings GROUP BY unique_id""",
)
def _(t: Tables):
    pct = scalars.percent(F.count("y"), F.count_if(F.col("y") > 300))
    return rounded(t.readings.groupBy("unique_id").agg(pct.alias("pct")), 4)


@check(
    "e06_log1p",
    """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(ln(1 + c_acctbal + 1e-6), 6) END AS log_shifted FROM customer""",
)
def _(t: Tables):
    return rounded(t.raw("customer").select("c_custkey", scalars.log1p_shifted(F.col("c_acctbal")).alias("log_shifted")), 6)


@check("e07_labelled_nulls", "SELECT unique_id, coalesce(location, '__MISSING__') AS location FROM metadata")
def _(t: Tables):
    return t.metadata.select("unique_id", scalars.label_or(F.col("location"), "__MISSING__").alias("location"))


@check(
    "e08_numeric_coercion",
    """SELECT conv_id, turn, try_cast(unnest(string_split(text, ' ')) AS DOUBLE) AS number FROM conversations""",
)
def _(t: Tables):
    words = t.raw("conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word"))
    return words.select("conv_id", "turn", scalars.to_number(F.col("word")).alias("number"))


@check(
    "e09_infinities_to_null",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
              CASE WHEN l_tax <> 0 THEN round(l_discount / l_tax, 6) END AS ratio FROM lineitem""",
)
def _(t: Tables):
    # IEEE division: x / 0 is an infinity or NaN
    ratio = F.when(F.col("l_tax") != 0, F.try_divide("l_discount", "l_tax")).when(F.col("l_discount") > 0, float("inf"))
    wild = t.raw("lineitem").withColumn("ratio", F.coalesce(ratio, F.lit(float("nan"))))
    return rounded(
        wild.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", scalars.finite_or_null(F.col("ratio")).alias("ratio")),
        6, "ratio",
    )


@check(
    "e11_on_the_hour",
    """SELECT unique_id, "timestamp", "timestamp" = date_trunc('hour', "timestamp") AS on_hour FROM orders_demand
       UNION ALL SELECT unique_id, "timestamp", "timestamp" = date_trunc('hour', "timestamp") AS on_hour FROM readings""",
)
def _(t: Tables):
    both = t.orders_demand.select("unique_id", "timestamp").unionByName(t.readings.select("unique_id", "timestamp"))
    return both.withColumn("on_hour", times.is_on_hour("timestamp"))
