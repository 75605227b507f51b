"""Joins and fit diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import Tables
from checks.registry import check, rounded
from loadcurve.operators import diagnostics, filters, joins
from loadcurve.operators.timeseries import resample, time_range


@check(
    "j01_readings_with_metadata",
    """SELECT r.unique_id, r."timestamp", r.y, m.location_id, m.building_class, m.cluster_size
       FROM readings r LEFT JOIN metadata m ON r.unique_id = m.unique_id""",
)
def _(t: Tables):
    return joins.join_metadata(t.readings, t.metadata, joins.METADATA_COLUMNS)


@check(
    "j01_readings_with_metadata_salted",
    """SELECT r.unique_id, r."timestamp", r.y, m.location_id, m.building_class, m.cluster_size
       FROM readings r LEFT JOIN metadata m ON r.unique_id = m.unique_id""",
)
def _(t: Tables):
    # the way taken when metadata is too large to broadcast
    return joins.join_metadata(t.readings, t.metadata, joins.METADATA_COLUMNS, max_broadcast_rows=0)


J2 = """SELECT d.unique_id, d."timestamp", d.y, m.location_id, w.temperature_2m
        FROM demand d LEFT JOIN metadata m ON d.unique_id = m.unique_id
        LEFT JOIN weather w ON m.location_id = w.location_id AND date_trunc('hour', d."timestamp") = w."timestamp" """


@check("j02_readings_with_weather", J2)
def _(t: Tables):
    located = joins.join_metadata(t.demand, t.metadata, ["location_id"])
    return joins.join_weather(located, t.weather, size_bound=t.weather_raw)


@check("j02_readings_with_weather_shuffled", J2)
def _(t: Tables):
    # the way taken when weather is too large to broadcast
    located = joins.join_metadata(t.demand, t.metadata, ["location_id"])
    return joins.join_weather(located, t.weather, max_broadcast_rows=0)


@check("j03_locations_in_both", "SELECT DISTINCT m.location_id FROM metadata m JOIN daily d ON m.location_id = d.location_id")
def _(t: Tables):
    return joins.keys_in_both(t.metadata, t.daily)


@check(
    "j04_locations_only_in_metadata",
    """SELECT DISTINCT location_id FROM metadata m
       WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.location_id = m.location_id)""",
)
def _(t: Tables):
    return joins.keys_only_left(t.metadata, t.daily)


@check(
    "j05_ranges_of_both_sides",
    """, a AS (SELECT location_id, min("timestamp") AS min_demand_ts, max("timestamp") AS max_demand_ts FROM merged GROUP BY 1),
        b AS (SELECT location_id, min("timestamp") AS min_weather_ts, max("timestamp") AS max_weather_ts FROM daily GROUP BY 1)
       SELECT coalesce(a.location_id, b.location_id) AS location_id, min_demand_ts, max_demand_ts, min_weather_ts, max_weather_ts
       FROM a FULL OUTER JOIN b ON a.location_id = b.location_id""",
)
def _(t: Tables):
    located = joins.join_metadata(t.orders_demand, t.metadata, ["location_id"])
    a = time_range(located, by=["location_id"]).withColumnsRenamed({"min_ts": "min_demand_ts", "max_ts": "max_demand_ts"})
    b = time_range(t.daily, by=["location_id"]).withColumnsRenamed({"min_ts": "min_weather_ts", "max_ts": "max_weather_ts"})
    return joins.compare_ranges(a, b)


@check(
    "j06_located_readings",
    """SELECT r.unique_id, r."timestamp", r.y, m.location_id FROM readings r
       JOIN metadata m ON r.unique_id = m.unique_id WHERE m.location_id IS NOT NULL""",
)
def _(t: Tables):
    return joins.join_located(t.readings, t.metadata)


@check(
    "j07_aligned_readings_and_weather",
    """SELECT r.unique_id, r."timestamp", r.y, m.location_id, date_trunc('hour', r."timestamp") AS timestamp_hour, w.temperature_2m
       FROM demand r JOIN metadata m ON r.unique_id = m.unique_id
       LEFT JOIN weather_raw w ON w.location_id = m.location_id
         AND date_trunc('hour', w."timestamp") = date_trunc('hour', r."timestamp")
       WHERE m.location_id IS NOT NULL""",
)
def _(t: Tables):
    return joins.join_weather_truncated(joins.join_located(t.demand, t.metadata), t.weather_raw, ["temperature_2m"])


@check(
    "j08_values_with_attributes",
    """SELECT r.unique_id, r.y, m.dataset, m.location FROM readings r LEFT JOIN metadata m ON r.unique_id = m.unique_id""",
)
def _(t: Tables):
    return joins.join_metadata(t.readings.select("unique_id", "y"), t.metadata, ["dataset", "location", "absent_column"])


LOST = """, lost AS (SELECT DISTINCT location_id, date_trunc('hour', "timestamp") AS "timestamp" FROM merged
          WHERE temperature_2m IS NULL AND location_id IS NOT NULL) """


def _lost(t: Tables):
    stamp = F.date_trunc("hour", "timestamp").alias("timestamp")
    return t.merged.filter(filters.missing_observation("temperature_2m")).select("location_id", stamp).distinct()


@check(
    "j09_falsely_unmatched_keys",
    LOST + """SELECT * FROM lost l WHERE EXISTS
              (SELECT 1 FROM daily_raw w WHERE w.location_id = l.location_id AND w."timestamp" = l."timestamp")""",
)
def _(t: Tables):
    return joins.existing_keys(_lost(t), t.daily_raw, ["location_id", "timestamp"])


@check(
    "j09_truly_absent_keys",
    LOST + """SELECT * FROM lost l WHERE NOT EXISTS
              (SELECT 1 FROM daily_raw w WHERE w.location_id = l.location_id AND w."timestamp" = l."timestamp")""",
)
def _(t: Tables):
    return joins.absent_keys(_lost(t), t.daily_raw, ["location_id", "timestamp"])


@check(
    "d01_key_coverage",
    """, l AS (SELECT DISTINCT location_id FROM metadata), r AS (SELECT DISTINCT location_id FROM daily),
        c AS (SELECT (SELECT count(*) FROM l) AS n_left, (SELECT count(*) FROM r) AS n_right,
                     (SELECT count(*) FROM l JOIN r ON l.location_id = r.location_id) AS n_common,
                     (SELECT count(*) FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.location_id = l.location_id)) AS n_left_only)
       SELECT *, round(100.0 * n_left_only / n_left, 4) AS left_only_pct FROM c""",
)
def _(t: Tables):
    return rounded(diagnostics.key_coverage(t.metadata, t.daily), 4)


RANGES = """, a AS (SELECT location_id, min("timestamp") AS min_demand_ts, max("timestamp") AS max_demand_ts FROM {left} GROUP BY 1),
     b AS (SELECT location_id, min("timestamp") AS min_weather_ts, max("timestamp") AS max_weather_ts FROM {right} GROUP BY 1),
     j AS (SELECT coalesce(a.location_id, b.location_id) AS location_id, min_demand_ts, max_demand_ts, min_weather_ts, max_weather_ts
           FROM a FULL OUTER JOIN b ON a.location_id = b.location_id),
     k AS (SELECT *, CAST(floor(epoch(min_weather_ts)) AS BIGINT) - CAST(floor(epoch(min_demand_ts)) AS BIGINT) AS starts_early_seconds,
                     CAST(floor(epoch(max_demand_ts)) AS BIGINT) - CAST(floor(epoch(max_weather_ts)) AS BIGINT) AS ends_late_seconds FROM j)
     SELECT location_id, min_demand_ts, max_demand_ts, min_weather_ts, max_weather_ts,
         CAST(starts_early_seconds AS DOUBLE) AS starts_early_seconds, CAST(ends_late_seconds AS DOUBLE) AS ends_late_seconds, concat_ws('; ',
         CASE WHEN location_id IS NULL THEN 'null key' END,
         CASE WHEN location_id IS NOT NULL AND min_demand_ts IS NULL THEN 'no demand' END,
         CASE WHEN location_id IS NOT NULL AND min_weather_ts IS NULL THEN 'no weather' END,
         CASE WHEN location_id IS NOT NULL AND starts_early_seconds > {tolerance} THEN 'starts early' END,
         CASE WHEN location_id IS NOT NULL AND ends_late_seconds > {tolerance} THEN 'ends late' END) AS issues
     FROM k"""


def _seconds_as_double(df):
    # nullable integers have no common pandas type on the two sides
    return df.withColumns({c: F.col(c).cast("double") for c in ("starts_early_seconds", "ends_late_seconds")})


@check("d02_range_alignment", RANGES.format(left="merged", right="daily", tolerance=86400))
def _(t: Tables):
    located = joins.join_metadata(t.orders_demand, t.metadata, ["location_id"])
    return _seconds_as_double(diagnostics.range_alignment(located, t.daily, tolerance_seconds=86400))


@check("d02_range_alignment_hourly", RANGES.format(left='(SELECT location_id, "timestamp" FROM demand LEFT JOIN metadata USING (unique_id))', right="weather", tolerance=3600))
def _(t: Tables):
    located = joins.join_metadata(t.demand, t.metadata, ["location_id"])
    return _seconds_as_double(diagnostics.range_alignment(located, t.weather))


@check(
    "d03_join_success",
    """, c AS (SELECT count(*) AS n_rows, count(location_id) AS n_located,
                count(*) FILTER (location_id IS NOT NULL AND temperature_2m IS NULL) AS n_located_unmatched,
                count(*) FILTER (temperature_2m IS NULL) AS n_unmatched FROM merged)
       SELECT *, round(100.0 * n_located_unmatched / n_located, 4) AS located_unmatched_pct,
              round(100.0 * n_unmatched / n_rows, 4) AS unmatched_pct FROM c""",
)
def _(t: Tables):
    return rounded(diagnostics.join_success(t.merged), 4)


@check(
    "d04_resample_check",
    """, h AS (SELECT unique_id, date_trunc('hour', "timestamp") AS "timestamp" FROM readings GROUP BY 1, 2)
       SELECT count(*) AS n_rows, count(*) FILTER ("timestamp" <> date_trunc('hour', "timestamp")) AS n_off_hour,
              count(*) FILTER ("timestamp" <> date_trunc('hour', "timestamp")) = 0 AS aligned FROM h""",
)
def _(t: Tables):
    return diagnostics.resample_check(resample(t.readings))


@check(
    "d04_off_hour_readings",
    """SELECT count(*) AS n_rows, count(*) FILTER ("timestamp" <> date_trunc('hour', "timestamp")) AS n_off_hour,
              count(*) FILTER ("timestamp" <> date_trunc('hour', "timestamp")) = 0 AS aligned FROM readings""",
)
def _(t: Tables):
    return diagnostics.resample_check(t.readings)


@check(
    "d05_unmatched_audit",
    LOST + """SELECT l.*, EXISTS (SELECT 1 FROM daily_raw w WHERE w.location_id = l.location_id AND w."timestamp" = l."timestamp") AS in_weather
              FROM lost l""",
)
def _(t: Tables):
    return diagnostics.unmatched_audit(t.merged, t.daily_raw)


QUALITY = """, d AS (SELECT unique_id, "timestamp", count(*) AS c FROM orders_demand GROUP BY 1, 2 HAVING count(*) > 1),
   m AS (SELECT unique_id, count(*) AS c FROM metadata GROUP BY 1 HAVING count(*) > 1),
   w AS (SELECT location_id, "timestamp", count(*) AS c FROM daily_raw GROUP BY 1, 2 HAVING count(*) > 1)
""" + " UNION ALL ".join(
    f"""SELECT '{table}' AS "table", 'missing' AS "check", '{column}' AS subject,
        CAST(count(*) FILTER ("{column}" IS NULL) AS VARCHAR) AS value FROM {source}"""
    for table, source, columns in (
        ("demand", "orders_demand", ["unique_id", "timestamp", "y", "o_orderkey"]),
        ("metadata", "metadata", ["unique_id", "location_id", "location", "dataset", "building_class", "cluster_size"]),
        ("weather", "daily_raw", [
            "location_id", "timestamp", "temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m",
            "weather_code", "is_day", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]),
    )
    for column in columns
) + "".join(
    f""" UNION ALL SELECT '{table}', 'duplicate_groups', '{keys}', CAST(count(*) AS VARCHAR) FROM {groups}
         UNION ALL SELECT '{table}', 'duplicate_extra_rows', '{keys}', CAST(CAST(coalesce(sum(c), 0) - count(*) AS BIGINT) AS VARCHAR) FROM {groups}"""
    for table, groups, keys in (
        ("demand", "d", "unique_id,timestamp"), ("metadata", "m", "unique_id"), ("weather", "w", "location_id,timestamp"))
) + "".join(
    f""" UNION ALL SELECT '{table}', 'first', 'timestamp', strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S') FROM {source}
         UNION ALL SELECT '{table}', 'last', 'timestamp', strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S') FROM {source}"""
    for table, source in (("demand", "orders_demand"), ("weather", "daily_raw"))
)


@check("d06_quality_report", QUALITY)
def _(t: Tables):
    return diagnostics.quality_report(
        {"demand": t.orders_demand, "metadata": t.metadata, "weather": t.daily_raw},
        {"demand": ["unique_id", "timestamp"], "metadata": ["unique_id"], "weather": ["location_id", "timestamp"]},
        {"demand": "timestamp", "weather": "timestamp"},
    )
