"""Checks on how well two tables fit together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcurve.functions.scalars import percent
from loadcurve.functions.times import is_on_hour
from loadcurve.operators.filters import missing_observation
from loadcurve.operators.joins import compare_ranges, possible_rows
from loadcurve.operators.profile import duplicate_summary, missing_values
from loadcurve.operators.timeseries import time_range
from loadcurve.session import stored


def key_coverage(left: DataFrame, right: DataFrame, key: str = "location_id") -> DataFrame:
    """One row: keys on each side, on both, and only on the left.

    A null key counts as a key of its side but matches nothing.  One aggregation over both key
    columns replaces separate distincts and joins.
    """
    sides = left.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(F.col(key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = sides.groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    in_left, in_right = F.col("l") == 1, F.col("r") == 1
    both = in_left & in_right & F.col("k").isNotNull()
    counts = per_key.agg(
        F.count_if(in_left).alias("n_left"),
        F.count_if(in_right).alias("n_right"),
        F.count_if(both).alias("n_common"),
        F.count_if(in_left & ~both).alias("n_left_only"),
    )
    return counts.withColumn("left_only_pct", percent(F.col("n_left_only"), F.col("n_left")))


def range_alignment(
    demand: DataFrame,
    weather: DataFrame,
    key: str = "location_id",
    timestamp: str = "timestamp",
    tolerance_seconds: int = 3600,
) -> DataFrame:
    """Per location: both time ranges, by how much demand sticks out, and which issue that is.

    Several issues are joined with ``; ``; an unproblematic location has an empty text.
    """
    d = demand.groupBy(key).agg(F.min(timestamp).alias("min_demand_ts"), F.max(timestamp).alias("max_demand_ts"))
    w = weather.groupBy(key).agg(F.min(timestamp).alias("min_weather_ts"), F.max(timestamp).alias("max_weather_ts"))
    early = F.unix_seconds("min_weather_ts") - F.unix_seconds("min_demand_ts")
    late = F.unix_seconds("max_demand_ts") - F.unix_seconds("max_weather_ts")
    located = F.col(key).isNotNull()
    issues = F.concat_ws(
        "; ",
        F.when(~located, "null key"),
        F.when(located & F.col("min_demand_ts").isNull(), "no demand"),
        F.when(located & F.col("min_weather_ts").isNull(), "no weather"),
        F.when(located & (F.col("starts_early_seconds") > tolerance_seconds), "starts early"),
        F.when(located & (F.col("ends_late_seconds") > tolerance_seconds), "ends late"),
    )
    return (
        compare_ranges(d, w, key)
        .withColumns({"starts_early_seconds": early, "ends_late_seconds": late})
        .withColumn("issues", issues)
        .orderBy(F.col(key).asc_nulls_last())
    )


def success_counts(measure: str = "temperature_2m", key: str = "location_id") -> list[Column]:
    """Aggregates over merged rows; they can be observed while the rows are written."""
    located, absent = F.col(key).isNotNull(), F.col(measure).isNull()
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(located).alias("n_located"),
        F.count_if(located & absent).alias("n_located_unmatched"),
        F.count_if(absent).alias("n_unmatched"),
    ]


def with_success_shares(counts: DataFrame) -> DataFrame:
    return counts.select(
        "*",
        percent(F.col("n_located_unmatched"), F.col("n_located")).alias("located_unmatched_pct"),
        percent(F.col("n_unmatched"), F.col("n_rows")).alias("unmatched_pct"),
    )


def join_success(merged: DataFrame, measure: str = "temperature_2m", key: str = "location_id") -> DataFrame:
    """One row on how many merged rows got an observation, in one pass over the merged table."""
    return with_success_shares(merged.agg(*success_counts(measure, key)))


def resample_check(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """One row: stamps that are off the hour, over the whole table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~is_on_hour(timestamp)).alias("n_off_hour")).withColumn(
        "aligned", F.col("n_off_hour") == 0
    )


def unmatched_audit(
    merged: DataFrame,
    weather: DataFrame,
    measure: str = "temperature_2m",
    key: str = "location_id",
    timestamp: str = "timestamp",
    unit: str = "hour",
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Distinct (location, time) keys without observation, and whether weather has them after all.

    The keys are stored when the frame is built; observations of other keys are dropped before the shuffle.
    """
    stamp = F.date_trunc(unit, F.col(timestamp)).alias(timestamp)
    # stored, since the filter of the observations and the join both need them
    keys = stored(merged.filter(missing_observation(measure, key, exclude)).select(key, stamp).distinct())
    present = possible_rows(weather.select(key, timestamp), keys, [key, timestamp]).distinct().withColumn("__seen", F.lit(True))
    return keys.join(present, [key, timestamp], "left").select(
        key, timestamp, F.col("__seen").isNotNull().alias("in_weather")
    )


def quality_report(
    tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], times: Mapping[str, str] | None = None
) -> DataFrame:
    """(table, check, subject, value): missing counts, duplicate counts and time range ends of each table."""

    def entries(table: str, df: DataFrame, *values) -> DataFrame:
        """One output row per (check, subject, value) of each input row."""
        structs = (
            F.struct(check.alias("check"), subject.alias("subject"), value.cast("string").alias("value"))
            for check, subject, value in values
        )
        return df.select(F.lit(table).alias("table"), F.inline(F.array(*structs)))

    parts = []
    for table, df in tables.items():
        parts.append(entries(table, missing_values(df), (F.lit("missing"), F.col("column"), F.col("n_missing"))))
        if table in keys:
            label = F.lit(",".join(keys[table]))
            parts.append(
                entries(
                    table,
                    duplicate_summary(df, keys[table]),
                    (F.lit("duplicate_groups"), label, F.col("n_groups")),
                    (F.lit("duplicate_extra_rows"), label, F.col("n_extra")),
                )
            )
        if times and table in times:
            subject = F.lit(times[table])
            first, last = (F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("min_ts", "max_ts"))
            span = time_range(df, times[table])
            parts.append(entries(table, span, (F.lit("first"), subject, first), (F.lit("last"), subject, last)))
    return reduce(DataFrame.unionByName, parts)
