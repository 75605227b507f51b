"""Readings + metadata + weather as one wide table, with diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcurve.functions.times import as_timestamp
from loadcurve.operators.diagnostics import join_success, key_coverage, range_alignment, success_counts, with_success_shares
from loadcurve.operators.joins import METADATA_COLUMNS, join_metadata, join_weather
from loadcurve.operators.timeseries import deduplicate_ordered
from loadcurve.sources.sinks import read_back, write_table
from loadcurve.sources.tables import load_tables


def unique_weather(weather: DataFrame, order_by: Sequence | None = None) -> DataFrame:
    """One weather row per location and time, the first in the given order.

    Without an order the remaining columns decide, so that a recomputed task keeps the same row.
    """
    keys = ["location_id", "timestamp"]
    order = list(order_by or [c for c in weather.columns if c not in keys])
    return deduplicate_ordered(as_timestamp(weather), keys, order or keys)


def merge_readings(
    demand: DataFrame,
    metadata: DataFrame,
    weather: DataFrame,
    metadata_columns: Sequence[str] = METADATA_COLUMNS,
    weather_order: Sequence | None = None,
    unit: str = "hour",
) -> DataFrame:
    """Every reading with its metadata and the weather of its location and hour."""
    with_metadata = join_metadata(as_timestamp(demand), metadata, metadata_columns)
    return join_weather(with_metadata, unique_weather(weather, weather_order), unit=unit, size_bound=weather)


def located_ranges(demand: DataFrame, metadata: DataFrame) -> DataFrame:
    """(location_id, timestamp) with the first and last reading of each series.

    Series are reduced to their extremes before metadata is joined, so coverage and range checks
    do not join the readings a second time.
    """
    extremes = as_timestamp(demand).groupBy("unique_id").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    located = join_metadata(extremes, metadata, ["location_id"])
    return located.select("location_id", F.explode(F.array("a", "b")).alias("timestamp"))


def merge_diagnostics(
    demand: DataFrame, metadata: DataFrame, weather: DataFrame, merged: DataFrame, measure: str = "temperature_2m",
    counts: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Key coverage, range alignment and join success.

    ``counts``, one row of ``success_counts`` seen while the merge was written, saves reading it again.
    """
    ranges = located_ranges(demand, metadata)
    weather = as_timestamp(weather)
    return {
        "coverage": key_coverage(ranges, weather),
        "ranges": range_alignment(ranges, weather),
        "success": join_success(merged, measure) if counts is None else with_success_shares(counts),
    }


def run_merge(
    spark: SparkSession,
    demand_path: str,
    metadata_path: str,
    weather_path: str,
    target: str,
    measure: str = "temperature_2m",
    weather_order: Sequence | None = None,
    unit: str = "hour",
) -> dict[str, DataFrame]:
    """Write the merged table and diagnose it; join success is counted by the tasks that write."""
    demand, metadata, weather = load_tables(spark, demand_path, metadata_path, weather_path)
    merged = merge_readings(demand, metadata, weather, weather_order=weather_order, unit=unit)
    seen = write_table(merged, target, inputs=[demand_path, metadata_path, weather_path], observe=success_counts(measure))
    written = read_back(spark, target)
    names = list(seen)
    counts = spark.range(1).select(*(F.lit(seen[n]).cast("long").alias(n) for n in names))
    return {"merged": written, **merge_diagnostics(demand, metadata, weather, written, measure, counts)}
