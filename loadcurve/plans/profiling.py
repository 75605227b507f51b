"""Profile of the three tables and of how they relate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from loadcurve.operators.correlation import (
    DEMAND_MEASURES, MATRIX_MEASURES, correlation_matrix, demand_weather_correlation, strong_pairs,
)
from loadcurve.operators.diagnostics import quality_report
from loadcurve.operators.filters import in_top_categories
from loadcurve.operators.joins import join_metadata
from loadcurve.operators.profile import (
    NON_NEGATIVE_MEASURES, boxplot_stats, describe, histogram, location_density, missing_location_breakdown, negative_counts,
    target_counts, value_shares,
)
from loadcurve.operators.projections import numeric_columns
from loadcurve.operators.timeseries import (
    average_by_all_parts, dominant_interval, interval_counts, intervals, multiple_intervals, top_intervals,
)
from loadcurve.operators.topk import top_categories, top_k, top_n_and_other
from loadcurve.sources.tables import WEATHER_CODES, WEATHER_MEASURES, table_profile

METADATA_CATEGORIES = ("dataset", "location", "timezone", "freq", "building_class")
METADATA_NUMBERS = ("latitude", "longitude", "cluster_size")


def profile_demand(demand: DataFrame) -> dict[str, DataFrame]:
    gaps = intervals(demand)
    return {
        "stats": describe(demand, ["y"], exact=False),
        "counts": target_counts(demand),
        "histogram": histogram(demand, "y"),
        "histogram_log": histogram(demand, "y", scale="log1p"),
        "averages": average_by_all_parts(demand),
        "intervals": top_k(interval_counts(gaps), 10, "count", ["diff_seconds"]),
        "series_intervals": top_intervals(gaps),
        "irregular_series": multiple_intervals(gaps),
    }


def profile_metadata(metadata: DataFrame) -> dict[str, DataFrame]:
    report = {}
    for c in METADATA_CATEGORIES:
        if c in metadata.columns:
            report[f"shares_{c}"] = value_shares(metadata, c)
            report[f"top_{c}"] = top_n_and_other(metadata, c, 15)
    numbers = numeric_columns(metadata, (), METADATA_NUMBERS)
    if numbers:
        report["stats"] = describe(metadata, numbers)
        report.update({f"histogram_{c}": histogram(metadata, c) for c in numbers})
    report["missing_location"] = missing_location_breakdown(metadata)
    if {"latitude", "longitude"} <= set(metadata.columns):
        report["location_density"] = location_density(metadata)
    return report


def profile_weather(weather: DataFrame, measures: Sequence[str] = tuple(WEATHER_MEASURES)) -> dict[str, DataFrame]:
    numbers = numeric_columns(weather, (), measures)
    gaps = intervals(weather, "location_id")
    matrix = correlation_matrix(weather, [c for c in MATRIX_MEASURES if c in numbers])
    report = {
        "stats": describe(weather, numbers, exact=False),
        "correlation": matrix,
        "strong_pairs": strong_pairs(matrix),
        "intervals": top_k(interval_counts(gaps), 10, "count", ["diff_seconds"]),
        "dominant_interval": dominant_interval(gaps),
        "series_intervals": top_intervals(gaps, "location_id"),
    }
    if set(NON_NEGATIVE_MEASURES) & set(numbers):
        report["negatives"] = negative_counts(weather)
    report.update({f"top_{c}": top_n_and_other(weather, c, 20) for c in WEATHER_CODES if c in weather.columns})
    return report


def profile_relations(
    demand: DataFrame, metadata: DataFrame, weather: DataFrame, top_locations: int = 10, unit: str = "hour"
) -> dict[str, DataFrame]:
    """Demand per building class, dataset and busiest location, and its correlation with weather."""
    wide = join_metadata(demand, metadata, ["building_class", "dataset", "location"])
    report = {}
    if "building_class" in wide.columns:
        report["by_building_class"] = boxplot_stats(wide, "building_class", "y", "__MISSING__")
    if "dataset" in wide.columns:
        report["by_dataset"] = describe(wide, ["y"], ["dataset"])
        report["box_by_dataset"] = boxplot_stats(wide, "dataset", "y", "Missing")
    if "location" in wide.columns:
        named = wide.fillna({"location": "Missing"})
        top = top_categories(named, "location", top_locations)
        report["by_location"] = boxplot_stats(in_top_categories(named, top, "location"), "location", "y")
    measures = [m for m in DEMAND_MEASURES if m in weather.columns]
    report["weather_correlation"] = demand_weather_correlation(demand, metadata, weather, measures, unit=unit)
    return report


def profile_tables(demand: DataFrame, metadata: DataFrame, weather: DataFrame, unit: str = "hour") -> dict[str, dict[str, DataFrame]]:
    """The whole profile.

    Entries are lazy frames, but building them counts sides that may be broadcast and stores the
    distinct values behind the box plots.
    """
    tables = {"demand": demand, "metadata": metadata, "weather": weather}
    keys = {"demand": ["unique_id", "timestamp"], "metadata": ["unique_id"], "weather": ["location_id", "timestamp"]}
    times = {"demand": "timestamp", "weather": "timestamp"}
    return {
        "demand": profile_demand(demand),
        "metadata": profile_metadata(metadata),
        "weather": profile_weather(weather),
        "relations": profile_relations(demand, metadata, weather, unit=unit),
        "quality": {"tables": table_profile(tables, partitions=True), "report": quality_report(tables, keys, times)},
    }
