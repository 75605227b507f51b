"""Aggregations, profiles, top-k reports and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import DAILY_MEASURES, Tables
from checks.registry import check, rounded
from loadcurve.functions.scalars import as_interval
from loadcurve.operators import profile, sampling, timeseries, topk

HOURLY_SQL = """SELECT unique_id, date_trunc('hour', "timestamp") AS "timestamp", round(sum(y), 5) AS y
                FROM readings GROUP BY 1, 2"""


@check("a01_hourly_resample", HOURLY_SQL)
def _(t: Tables):
    return rounded(timeseries.resample(t.readings), 5, "y")


@check(
    "a01_half_day_resample",
    """SELECT unique_id, time_bucket(INTERVAL '12 hours', "timestamp", TIMESTAMP '1970-01-01') AS "timestamp", round(sum(y), 5) AS y
       FROM readings GROUP BY 1, 2""",
)
def _(t: Tables):
    return rounded(timeseries.resample(t.readings, every="12 hours"), 5, "y")


def stats_sql(source: str, column: str, label: str, by: str = "", digits: int = 4) -> str:
    group = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"""SELECT {group}'{label}' AS "column", count({column}) AS count, round(avg({column}), {digits}) AS mean,
        round(stddev_samp({column}), {digits}) AS stddev, round(CAST(min({column}) AS DOUBLE), {digits}) AS min,
        round(quantile_cont(CAST({column} AS DOUBLE), 0.25), {digits}) AS q25, round(quantile_cont(CAST({column} AS DOUBLE), 0.5), {digits}) AS q50,
        round(quantile_cont(CAST({column} AS DOUBLE), 0.75), {digits}) AS q75, round(CAST(max({column}) AS DOUBLE), {digits}) AS max FROM {source}{tail}"""


@check("a02_target_stats", stats_sql("readings", "y", "y", digits=4))
def _(t: Tables):
    return rounded(profile.describe(t.readings, ["y"]), 4)


def rank_sql(source: str, column: str) -> str:
    shares = ", ".join(
        f"round(count(*) FILTER (v <= q[{i + 1}]) / CAST(count(v) AS DOUBLE), 2) AS share_{name}"
        for i, name in enumerate(("q25", "q50", "q75"))
    )
    return f"""SELECT '{column}' AS "column", count(v) AS count, round(avg(v), 4) AS mean, {shares}
        FROM (SELECT CAST({column} AS DOUBLE) AS v, (SELECT quantile_disc(CAST({column} AS DOUBLE), [0.25, 0.5, 0.75]) FROM {source}) AS q
              FROM {source})"""


def _ranks_of_sketch(df, columns):
    """How much of the data lies up to each sketch quantile, which the sketch promises within its error."""
    stats = profile.describe(df, columns, exact=False).withColumnRenamed("column", "of")
    long = profile.to_long(df, columns)
    found = long.join(F.broadcast(stats), F.col("column") == F.col("of")).groupBy("column", "count", "mean")
    shares = (
        (F.count_if(F.col("value") <= F.col(q)) / F.count("value")).alias(f"share_{q}") for q in ("q25", "q50", "q75")
    )
    return rounded(rounded(found.agg(*shares), 4, "mean"), 2, "share_q25", "share_q50", "share_q75")


@check("a02_target_stats_sketched", rank_sql("readings", "y"))
def _(t: Tables):
    return _ranks_of_sketch(t.readings, ["y"])


@check("a03_weather_stats", " UNION ALL ".join(stats_sql("daily_raw", c, c) for c in DAILY_MEASURES))
def _(t: Tables):
    return rounded(profile.describe(t.daily_raw, DAILY_MEASURES), 4)


@check("a03_weather_stats_sketched", " UNION ALL ".join(rank_sql("daily_raw", c) for c in DAILY_MEASURES))
def _(t: Tables):
    return _ranks_of_sketch(t.daily_raw, DAILY_MEASURES)


@check("a04_metadata_stats", stats_sql("metadata", "cluster_size", "cluster_size"))
def _(t: Tables):
    return rounded(profile.describe(t.metadata, ["cluster_size"]), 4)


@check(
    "a05_target_stats_per_dataset",
    ", x AS (SELECT r.y, m.dataset FROM readings r LEFT JOIN metadata m ON r.unique_id = m.unique_id) "
    + stats_sql("x", "y", "y", by="dataset", digits=4),
)
def _(t: Tables):
    from loadcurve.operators.joins import join_metadata

    return rounded(profile.describe(join_metadata(t.readings, t.metadata, ["dataset"]), ["y"], ["dataset"]), 4)


@check("a05_target_stats_per_series", stats_sql("readings", "y", "y", by="unique_id", digits=4))
def _(t: Tables):
    return rounded(profile.describe(t.readings, ["y"], ["unique_id"]), 4)


@check(
    "a06_target_counts",
    """, c AS (SELECT count(*) AS n_rows, count(c_acctbal) AS n_valid, count(*) FILTER (c_acctbal IS NULL) AS n_null,
                      count(*) FILTER (c_acctbal <= 0) AS n_non_positive FROM customer)
       SELECT *, round(100.0 * n_null / n_rows, 4) AS null_pct, round(100.0 * n_non_positive / n_valid, 4) AS non_positive_pct FROM c""",
)
def _(t: Tables):
    return rounded(profile.target_counts(t.raw("customer"), "c_acctbal"), 4)


@check(
    "a06_reading_counts",
    """, c AS (SELECT count(*) AS n_rows, count(y) AS n_valid, count(*) FILTER (y IS NULL) AS n_null,
                      count(*) FILTER (y <= 0) AS n_non_positive FROM readings)
       SELECT *, round(100.0 * n_null / n_rows, 4) AS null_pct, round(100.0 * n_non_positive / n_valid, 4) AS non_positive_pct FROM c""",
)
def _(t: Tables):
    return rounded(profile.target_counts(t.readings), 4)


MERGED_COLUMNS = [
    "unique_id", "timestamp", "y", "o_orderkey", "location_id", "building_class", "cluster_size", *DAILY_MEASURES,
]


@check(
    "a07_missing_values",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ("{c}" IS NULL) AS n_missing,
            round(100.0 * count(*) FILTER ("{c}" IS NULL) / count(*), 4) AS missing_pct FROM merged"""
        for c in MERGED_COLUMNS
    ),
)
def _(t: Tables):
    return rounded(profile.missing_values(t.merged), 4)


@check(
    "a08_duplicate_summary",
    """, g AS (SELECT count(*) AS c FROM weather_raw GROUP BY location_id, "timestamp" HAVING count(*) > 1)
       SELECT count(*) AS n_groups, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_rows,
              CAST(coalesce(sum(c), 0) - count(*) AS BIGINT) AS n_extra FROM g""",
)
def _(t: Tables):
    return profile.duplicate_summary(t.weather_raw, ["location_id", "timestamp"])


@check("a08_duplicate_groups", """SELECT location_id, "timestamp", count(*) AS count FROM weather_raw GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t: Tables):
    return profile.duplicate_groups(t.weather_raw, ["location_id", "timestamp"])


@check("a09_distinct_weather_keys", """SELECT DISTINCT location_id, "timestamp" FROM daily_raw""")
def _(t: Tables):
    return timeseries.deduplicate(t.daily_raw, ["location_id", "timestamp"]).select("location_id", "timestamp")


@check("a09_first_weather_row", """SELECT location_id, "timestamp", temperature_2m FROM weather""")
def _(t: Tables):
    return timeseries.deduplicate_ordered(t.weather_raw, ["location_id", "timestamp"], ["event_id"]).drop("event_id")


@check("a10_distinct_locations", "SELECT DISTINCT location_id FROM metadata")
def _(t: Tables):
    return timeseries.distinct_keys(t.metadata, "location_id")


@check("a10_location_count", "SELECT count(*) AS n_keys FROM (SELECT DISTINCT location_id FROM metadata)")
def _(t: Tables):
    return timeseries.key_count(t.metadata, "location_id")


@check("a11_time_range", """SELECT min("timestamp") AS min_ts, max("timestamp") AS max_ts FROM readings""")
def _(t: Tables):
    return timeseries.time_range(t.readings)


@check("a12_time_range_per_location", """SELECT location_id, min("timestamp") AS min_ts, max("timestamp") AS max_ts FROM merged GROUP BY 1""")
def _(t: Tables):
    return timeseries.time_range(t.merged, by=["location_id"])


@check(
    "a13_negative_counts",
    """SELECT 'c_acctbal' AS "column", count(*) FILTER (c_acctbal < 0) AS n_negative FROM customer
       UNION ALL SELECT 'c_nationkey', count(*) FILTER (c_nationkey < 0) FROM customer""",
)
def _(t: Tables):
    return profile.negative_counts(t.raw("customer"), ["c_acctbal", "c_nationkey", "c_name"])


@check("a13_negative_precipitation", """SELECT 'precipitation' AS "column", count(*) FILTER (precipitation < 0) AS n_negative FROM daily_raw""")
def _(t: Tables):
    return profile.negative_counts(t.daily_raw)


def completeness_sql(source: str, step: int) -> str:
    return f""", p AS (SELECT location_id, min("timestamp") AS min_ts, max("timestamp") AS max_ts, count(*) AS actual_records
                       FROM {source} GROUP BY 1),
        q AS (SELECT *, CAST(floor((epoch(max_ts) - epoch(min_ts)) / {step} + 1) AS BIGINT) AS expected_records FROM p) """


@check(
    "a14_completeness_per_location",
    completeness_sql("daily", 86400) + "SELECT *, round(100.0 * actual_records / expected_records, 4) AS completeness_pct FROM q",
)
def _(t: Tables):
    return rounded(timeseries.completeness(t.daily, step_seconds=86400), 4)


@check(
    "a14_hourly_completeness",
    completeness_sql("weather", 3600) + "SELECT *, round(100.0 * actual_records / expected_records, 4) AS completeness_pct FROM q",
)
def _(t: Tables):
    return rounded(timeseries.completeness(t.weather), 4)


@check(
    "a15_overall_completeness",
    completeness_sql("daily", 86400)
    + """SELECT CAST(sum(actual_records) AS BIGINT) AS actual_records, CAST(sum(expected_records) AS BIGINT) AS expected_records,
         round(100.0 * sum(actual_records) / sum(expected_records), 4) AS completeness_pct FROM q""",
)
def _(t: Tables):
    return rounded(timeseries.overall_completeness(timeseries.completeness(t.daily, step_seconds=86400)), 4)


PARTS = {"hour": 'hour("timestamp")', "dayofweek": 'dayofweek("timestamp") + 1', "month": 'month("timestamp")'}


def _average(part: str):
    source = "readings" if part == "hour" else "orders_demand"

    @check(
        f"a16_average_by_{part}",
        f"SELECT CAST({PARTS[part]} AS INTEGER) AS {part}, round(avg(y), 3) AS avg_demand FROM {source} GROUP BY 1",
    )
    def _(t: Tables):
        return rounded(timeseries.average_by(getattr(t, source), part), 3)


for _part in PARTS:
    _average(_part)


@check(
    "a16_averages_in_one_pass",
    " UNION ALL ".join(
        f"SELECT '{p}' AS part, CAST({e} AS INTEGER) AS position, round(avg(y), 3) AS avg_demand FROM readings GROUP BY 2"
        for p, e in PARTS.items()
    ),
)
def _(t: Tables):
    return rounded(timeseries.average_by_all_parts(t.readings), 3)


@check("a17_value_counts", "SELECT location AS value, count(*) AS count FROM metadata GROUP BY 1")
def _(t: Tables):
    return profile.value_counts(t.metadata, "location")


@check(
    "a18_value_shares",
    "SELECT location AS value, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM metadata GROUP BY 1",
)
def _(t: Tables):
    return profile.value_shares(t.metadata, "location")


@check("a18_distinct_values", "SELECT count(*) AS n_distinct FROM (SELECT DISTINCT location FROM metadata)")
def _(t: Tables):
    return profile.distinct_values(t.metadata, "location")


GAPS = """, gaps AS (SELECT * FROM (SELECT unique_id, "timestamp",
      CAST(floor(epoch_us("timestamp") / 1000000.0) AS BIGINT)
      - lag(CAST(floor(epoch_us("timestamp") / 1000000.0) AS BIGINT)) OVER (PARTITION BY unique_id ORDER BY "timestamp") AS diff_seconds
    FROM readings) WHERE diff_seconds IS NOT NULL),
  daily_gaps AS (SELECT * FROM (SELECT location_id, "timestamp",
      CAST(epoch("timestamp") AS BIGINT) - lag(CAST(epoch("timestamp") AS BIGINT)) OVER (PARTITION BY location_id ORDER BY "timestamp") AS diff_seconds
    FROM daily) WHERE diff_seconds IS NOT NULL) """


@check("a19_common_intervals", GAPS + "SELECT diff_seconds, count(*) AS count FROM gaps GROUP BY 1 ORDER BY count DESC, diff_seconds LIMIT 10")
def _(t: Tables):
    return topk.top_k(timeseries.interval_counts(timeseries.intervals(t.readings)), 10, "count", ["diff_seconds"])


@check("a19_common_daily_intervals", GAPS + "SELECT diff_seconds, count(*) AS count FROM daily_gaps GROUP BY 1 ORDER BY count DESC, diff_seconds LIMIT 10")
def _(t: Tables):
    gaps = timeseries.intervals(t.daily, "location_id")
    return topk.top_k(timeseries.interval_counts(gaps), 10, "count", ["diff_seconds"])


@check(
    "e10_readable_intervals",
    GAPS + """SELECT DISTINCT diff_seconds, printf('INTERVAL ''%d %02d:%02d:%02d'' DAY TO SECOND', diff_seconds // 86400,
                diff_seconds // 3600 % 24, diff_seconds // 60 % 60, diff_seconds % 60) AS shown FROM gaps""",
)
def _(t: Tables):
    counts = timeseries.interval_counts(timeseries.intervals(t.readings))
    return counts.select("diff_seconds", as_interval(F.col("diff_seconds")).cast("string").alias("shown"))


@check(
    "a20_dominant_interval",
    GAPS + """SELECT diff_seconds, diff_seconds = 86400 AS is_expected FROM daily_gaps GROUP BY 1
              ORDER BY count(*) DESC, diff_seconds LIMIT 1""",
)
def _(t: Tables):
    return timeseries.dominant_interval(timeseries.intervals(t.daily, "location_id"), 86400)


@check(
    "a20_series_with_multiple_intervals",
    GAPS + "SELECT unique_id, count(DISTINCT diff_seconds) AS n_intervals, count(DISTINCT diff_seconds) > 1 AS multiple FROM gaps GROUP BY 1",
)
def _(t: Tables):
    return timeseries.multiple_intervals(timeseries.intervals(t.readings))


@check("a21_rows_without_location", "SELECT * FROM metadata WHERE location_id IS NULL AND location IS NULL")
def _(t: Tables):
    return profile.rows_without_location(t.metadata)


@check(
    "a21_missing_location_breakdown",
    """, x AS (SELECT * FROM metadata WHERE location_id IS NULL AND location IS NULL),
        u AS (SELECT 'dataset' AS attribute, dataset AS value FROM x UNION ALL SELECT 'building_class', building_class FROM x)
       SELECT attribute, value, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM x), 2) AS pct FROM u GROUP BY 1, 2""",
)
def _(t: Tables):
    return profile.missing_location_breakdown(t.metadata)


def box_sql(source: str, category: str, value: str, digits: int) -> str:
    return f""", u AS (
        SELECT {category}, 'original' AS scale, CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL AND {category} IS NOT NULL
        UNION ALL
        SELECT {category}, 'log1p', ln(1 + {value} + 1e-6) FROM {source} WHERE {value} >= 0 AND {category} IS NOT NULL),
      q AS (SELECT {category}, scale, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75
            FROM u GROUP BY 1, 2)
      SELECT u.{category}, u.scale, round(q25, {digits}) AS q25, round(q50, {digits}) AS q50, round(q75, {digits}) AS q75, count(*) AS count,
        round(min(v) FILTER (v >= q25 - 1.5 * (q75 - q25) AND v <= q75 + 1.5 * (q75 - q25)), {digits}) AS whisker_low,
        round(max(v) FILTER (v >= q25 - 1.5 * (q75 - q25) AND v <= q75 + 1.5 * (q75 - q25)), {digits}) AS whisker_high,
        count(*) FILTER (NOT (v >= q25 - 1.5 * (q75 - q25) AND v <= q75 + 1.5 * (q75 - q25))) AS n_outliers
      FROM u JOIN q ON u.{category} = q.{category} AND u.scale = q.scale GROUP BY u.{category}, u.scale, q25, q50, q75"""


@check(
    "a22_boxplot_by_class",
    ", x AS (SELECT r.y, m.building_class FROM readings r LEFT JOIN metadata m ON r.unique_id = m.unique_id) "
    + box_sql("x", "building_class", "y", 4),
)
def _(t: Tables):
    from loadcurve.operators.joins import join_metadata

    return rounded(profile.boxplot_stats(join_metadata(t.readings, t.metadata, ["building_class"]), "building_class", "y"), 4)


@check(
    "a22_boxplot_with_missing_label",
    ", x AS (SELECT cluster_size, coalesce(location, '__MISSING__') AS location FROM metadata) " + box_sql("x", "location", "cluster_size", 4),
)
def _(t: Tables):
    return rounded(profile.boxplot_stats(t.metadata, "location", "cluster_size", "__MISSING__"), 4)


def histogram_sql(value: str, source: str, bins: int, digits: int) -> str:
    return f""", x AS (SELECT CAST({value} AS DOUBLE) AS x FROM {source} WHERE {value} IS NOT NULL),
        l AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
        b AS (SELECT least(CAST(floor((x - lo) * {bins} / (hi - lo)) AS INTEGER) + 1, {bins}) AS bin, count(*) AS n FROM x, l GROUP BY 1),
        e AS (SELECT CAST(unnest(range(1, {bins + 1})) AS INTEGER) AS bin)
      SELECT e.bin, round(lo + (e.bin - 1) * (hi - lo) / {float(bins)}, {digits}) AS bin_start,
             round(lo + e.bin * (hi - lo) / {float(bins)}, {digits}) AS bin_end, coalesce(b.n, 0) AS n
      FROM e CROSS JOIN l LEFT JOIN b ON e.bin = b.bin"""


@check("a23_histogram", histogram_sql("y", "readings", 30, 5))
def _(t: Tables):
    return rounded(profile.histogram(t.readings, "y"), 5)


@check("a23_histogram_log1p", histogram_sql("ln(1 + y)", "readings", 30, 5))
def _(t: Tables):
    return rounded(profile.histogram(t.readings, "y", scale="log1p"), 5)


@check(
    "a24_location_density",
    """SELECT round(CAST(embedding[1] AS DOUBLE), 1) AS lat, round(CAST(embedding[2] AS DOUBLE), 1) AS lon, count(*) AS count
       FROM embeddings GROUP BY 1, 2""",
)
def _(t: Tables):
    points = t.raw("embeddings").select(
        F.col("embedding")[0].cast("double").alias("latitude"), F.col("embedding")[1].cast("double").alias("longitude")
    )
    return profile.location_density(points)


@check("l01_sorted_by_location", """SELECT location_id, "timestamp", temperature_2m FROM weather""")
def _(t: Tables):
    return topk.sorted_by(t.weather, "location_id", "timestamp")


@check("l02_sorted_nulls_last", "SELECT location_id, unique_id FROM metadata")
def _(t: Tables):
    return topk.sorted_by(t.metadata.select("location_id", "unique_id"), "location_id", "unique_id", nulls_last=True)


@check("l03_top_customers", "SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 ORDER BY count DESC, o_custkey LIMIT 10")
def _(t: Tables):
    return topk.top_k(t.raw("orders").groupBy("o_custkey").count(), 10, "count", ["o_custkey"])


def other_sql(source: str, category: str, n: int) -> str:
    return f""", c AS (SELECT coalesce(CAST({category} AS VARCHAR), 'NaN') AS category, count(*) AS c FROM {source} GROUP BY 1),
        r AS (SELECT *, row_number() OVER (ORDER BY c DESC, category) AS rn FROM c)
      SELECT CASE WHEN rn <= {n} THEN category ELSE 'Other' END AS category,
             CAST(least(rn, {n + 1}) AS INTEGER) AS rank, CAST(sum(c) AS BIGINT) AS count FROM r GROUP BY 1, 2"""


@check("l04_top_locations_and_other", other_sql("metadata", "location", 10))
def _(t: Tables):
    return topk.top_n_and_other(t.metadata, "location", 10)


@check("l04_top_sources_and_other", other_sql("documents", "source", 15))
def _(t: Tables):
    return topk.top_n_and_other(t.raw("documents"), "source", 15)


@check("l04_few_weather_codes", other_sql("daily_raw", "weather_code", 20))
def _(t: Tables):
    return topk.top_n_and_other(t.daily_raw, "weather_code", 20)


@check(
    "l05_boxplot_of_top_locations",
    """, y AS (SELECT r.y, coalesce(m.location, 'Missing') AS location FROM readings r LEFT JOIN metadata m ON r.unique_id = m.unique_id),
        x AS (SELECT * FROM y WHERE location IN (SELECT location FROM y GROUP BY 1 ORDER BY count(*) DESC, location LIMIT 10)) """
    + box_sql("x", "location", "y", 4),
)
def _(t: Tables):
    from loadcurve.operators.filters import in_top_categories
    from loadcurve.operators.joins import join_metadata

    named = join_metadata(t.readings, t.metadata, ["location"]).fillna({"location": "Missing"})
    top = topk.top_categories(named, "location", 10)
    return rounded(profile.boxplot_stats(in_top_categories(named, top, "location"), "location", "y"), 4)


def _within_bounds(sampled: int, rows: int, fraction: float) -> bool:
    """Six standard deviations of a binomial count."""
    return abs(sampled - fraction * rows) <= 6 * (rows * fraction * (1 - fraction)) ** 0.5


def _report_holds(rows: list[dict], t: Tables) -> bool:
    (row,) = rows
    n = t.readings.count()
    return (
        row["n_rows"] == n
        and _within_bounds(row["n_sampled"], n, 0.1)
        and abs(row["achieved_fraction"] - row["n_sampled"] / n) < 1e-9
    )


@check("m01_row_sample_report", holds=_report_holds)
def _(t: Tables):
    return sampling.sample_report(t.readings, 0.1)


@check("m01_row_sample", holds=lambda rows, t: _within_bounds(len(rows), t.readings.count(), 0.05))
def _(t: Tables):
    return sampling.sample_rows(t.readings, 0.05)


@check(
    "m01_sample_properties",
    "SELECT count(*) AS n_rows, true AS all_from_input, true AS share_in_bounds, true AS repeatable FROM readings",
)
def _(t: Tables):
    sample, again = sampling.sample_rows(t.readings, 0.05), sampling.sample_rows(t.readings, 0.05)
    n, k = F.col("n_rows"), F.col("n_sampled")
    size = F.count(F.lit(1))
    counts = t.readings.agg(size.alias("n_rows")).withColumns(
        {
            "n_sampled": sample.agg(size).scalar(),
            "n_foreign": sample.exceptAll(t.readings).agg(size).scalar(),
            "n_changed": sample.exceptAll(again).unionAll(again.exceptAll(sample)).agg(size).scalar(),
        }
    )
    return counts.select(
        "n_rows",
        (F.col("n_foreign") == 0).alias("all_from_input"),
        (F.abs(k - 0.05 * n) <= 6 * F.sqrt(n * 0.05 * 0.95)).alias("share_in_bounds"),
        (F.col("n_changed") == 0).alias("repeatable"),
    )


@check(
    "m02_sampled_series",
    """, ids AS (SELECT unique_id FROM (SELECT DISTINCT unique_id FROM readings)
                ORDER BY md5('42:' || CAST(unique_id AS VARCHAR)), unique_id LIMIT 5)
       SELECT * FROM readings WHERE unique_id IN (SELECT unique_id FROM ids)""",
)
def _(t: Tables):
    return sampling.sample_series(t.readings, n=5)


@check(
    "m03_series_sampled_from_metadata",
    """, ids AS (SELECT unique_id FROM metadata ORDER BY md5('7:' || CAST(unique_id AS VARCHAR)), unique_id LIMIT 50)
       SELECT unique_id, "timestamp", y FROM orders_demand WHERE unique_id IN (SELECT unique_id FROM ids)""",
)
def _(t: Tables):
    return sampling.sample_series(
        t.orders_demand, n=50, seed=7, columns=["unique_id", "timestamp", "y"], ids_from=t.metadata
    )
