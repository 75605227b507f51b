"""Resampling, ranges, completeness and intervals of keyed series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.functions.scalars import percent
from loadcurve.functions.times import as_timestamp
from loadcurve.operators.skew import MAX_SERIES_ROWS, lay_out_by_rows
from loadcurve.sources.tables import require_columns

def resample(
    df: DataFrame, key: str = "unique_id", timestamp: str = "timestamp", value: str = "y", every: str = "1 hour"
) -> DataFrame:
    """Sum of the value per series and tumbling window, stamped with the window start.

    Rows without a usable timestamp are left out.  Sums are formed map-side before the shuffle.
    """
    require_columns(df, key, timestamp, value)
    df = as_timestamp(df, timestamp)
    grouped = df.groupBy(key, F.window(timestamp, every).alias("w")).agg(F.sum(value).alias(value))
    return grouped.select(key, F.col("w.start").alias(timestamp), value)


def deduplicate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key; which one is left open."""
    return df.dropDuplicates(list(keys))


def deduplicate_ordered(df: DataFrame, keys: Sequence[str], order_by: Sequence) -> DataFrame:
    """One row per key, the first in the given order.

    Where one whole number decides and all other columns have a fixed width, each task keeps the winner per key
    while it reads, without a sort.  Otherwise Spark's ``= 1`` limit on the row number applies before the shuffle
    as well.  Copies of one key do not travel either way.
    """
    rest = [c for c in df.columns if c not in keys]
    by = order_by[0] if len(order_by) == 1 and isinstance(order_by[0], str) else None
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if by in rest and isinstance(df.schema[by].dataType, T.IntegralType) and all(isinstance(df.schema[c].dataType, fixed) for c in rest):
        # a null comes first in the order; as a least value it would be passed over
        rank = F.coalesce(F.col(f"`{by}`").cast("long"), F.lit(-(1 << 63)))
        return df.groupBy(*keys).agg(*(F.min_by(f"`{c}`", rank).alias(c) for c in rest)).select(df.columns)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("__rn", first).filter(F.col("__rn") == 1).drop("__rn")


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def key_count(df: DataFrame, *keys: str) -> DataFrame:
    """Number of distinct keys, a null key included."""
    return distinct_keys(df, *keys).agg(F.count(F.lit(1)).alias("n_keys"))


def time_range(df: DataFrame, timestamp: str = "timestamp", by: Sequence[str] = ()) -> DataFrame:
    """First and last timestamp, over the table or per key."""
    return df.groupBy(*by).agg(F.min(timestamp).alias("min_ts"), F.max(timestamp).alias("max_ts"))


def completeness(
    df: DataFrame, key: str = "location_id", timestamp: str = "timestamp", step_seconds: int = 3600
) -> DataFrame:
    """Records found against records expected between a series' first and last stamp."""
    ranges = df.groupBy(key).agg(
        F.min(timestamp).alias("min_ts"), F.max(timestamp).alias("max_ts"), F.count(F.lit(1)).alias("actual_records")
    )
    span = F.unix_timestamp("max_ts") - F.unix_timestamp("min_ts")
    expected = (span / F.lit(step_seconds) + 1).cast("long")
    return ranges.withColumn("expected_records", expected).withColumn(
        "completeness_pct", percent(F.col("actual_records"), F.col("expected_records"))
    )


def overall_completeness(per_key: DataFrame) -> DataFrame:
    """Totals over all series of ``completeness``."""
    totals = per_key.agg(
        F.sum("actual_records").alias("actual_records"), F.sum("expected_records").alias("expected_records")
    )
    return totals.withColumn("completeness_pct", percent(F.col("actual_records"), F.col("expected_records")))


def average_by(df: DataFrame, part: str, timestamp: str = "timestamp", value: str = "y") -> DataFrame:
    """Mean value per hour, day of week (Sunday = 1) or month."""
    parts = {"hour": F.hour, "dayofweek": F.dayofweek, "month": F.month}
    return df.groupBy(parts[part](F.col(timestamp)).alias(part)).agg(F.mean(value).alias("avg_demand"))


def average_by_all_parts(df: DataFrame, timestamp: str = "timestamp", value: str = "y") -> DataFrame:
    """The three averages from one scan: (part, position, avg_demand)."""
    ts = F.col(timestamp)
    parts = df.select(
        F.hour(ts).alias("hour"), F.dayofweek(ts).alias("dayofweek"), F.month(ts).alias("month"), F.col(value).alias("v")
    )
    sets = parts.groupingSets([["hour"], ["dayofweek"], ["month"]], "hour", "dayofweek", "month").agg(
        F.grouping_id().alias("g"), F.mean("v").alias("avg_demand")
    )
    # grouping_id has one bit per column that is aggregated away
    part = F.when(F.col("g") == 3, "hour").when(F.col("g") == 5, "dayofweek").otherwise("month")
    position = F.when(F.col("g") == 3, F.col("hour")).when(F.col("g") == 5, F.col("dayofweek")).otherwise(F.col("month"))
    return sets.select(part.alias("part"), position.alias("position"), "avg_demand")


def intervals(
    df: DataFrame,
    key: str = "unique_id",
    timestamp: str = "timestamp",
    tiebreak: Sequence[str] = (),
    max_series_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """Seconds since the previous record of the series; the first record of a series is left out."""
    df = as_timestamp(df.select(key, timestamp, *tiebreak), timestamp)
    layout = lay_out_by_rows(df, key, timestamp, 1, max_series_rows, tiebreak)
    order = Window.partitionBy(*layout.partition_by).orderBy(*layout.order_by)
    seconds = F.unix_seconds(F.col(timestamp))
    with_gap = layout.frame.withColumn("diff_seconds", seconds - F.lag(seconds).over(order))
    return layout.own_rows(with_gap).filter(F.col("diff_seconds").isNotNull())


def interval_counts(gaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Records per interval length, over all series or per series."""
    return gaps.groupBy(*by, "diff_seconds").agg(F.count(F.lit(1)).alias("count"))


def dominant_interval(gaps: DataFrame, expected_seconds: int = 3600) -> DataFrame:
    """One row: the most frequent interval (shortest on ties) and whether it is the expected one."""
    best = F.max_by("diff_seconds", F.struct(F.col("count"), -F.col("diff_seconds")))
    return interval_counts(gaps).agg(best.alias("diff_seconds")).withColumn(
        "is_expected", F.col("diff_seconds") == expected_seconds
    )


def multiple_intervals(gaps: DataFrame, key: str = "unique_id") -> DataFrame:
    """Per series: number of different intervals and whether there is more than one."""
    per_key = interval_counts(gaps, [key]).groupBy(key).agg(F.count(F.lit(1)).alias("n_intervals"))
    return per_key.withColumn("multiple", F.col("n_intervals") > 1)


def top_intervals(gaps: DataFrame, key: str = "unique_id", n: int = 5) -> DataFrame:
    """The n most frequent intervals of each series, ranked (shorter first on ties)."""
    counts = interval_counts(gaps, [key])
    order = Window.partitionBy(key).orderBy(F.desc("count"), F.asc("diff_seconds"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
