"""Calendar and rolling features over the merged table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from loadcurve.functions.times import calendar_features
from loadcurve.operators.filters import with_target, without_initial_window
from loadcurve.operators.sampling import sample_rows
from loadcurve.operators.rolling import FEATURE_WINDOWS, ROLLING_STATS, rolling_features
from loadcurve.sources.sinks import read_back, write_partitioned
from loadcurve.sources.tables import read_table


def build_features(
    merged: DataFrame,
    windows: Sequence[int] = FEATURE_WINDOWS,
    target: str = "y",
    sample_fraction: float | None = None,
    initial_window: str = "null",
    **rolling,
) -> DataFrame:
    """Calendar columns, rolling columns, then the rows with a known target.

    ``initial_window="full"`` also drops records whose widest frame is not filled yet.  Further
    keywords go to ``rolling_features``.
    """
    if sample_fraction is not None:
        merged = sample_rows(merged, sample_fraction)
    full = initial_window == "full"
    stats = tuple(ROLLING_STATS) + (("rows",) if full else ())
    featured = rolling_features(calendar_features(merged), target, windows, stats, **rolling)
    kept = without_initial_window(with_target(featured, target), max(windows), target, initial_window)
    return kept.drop(*(f"{target}_rolling_rows_{n}h" for n in windows)) if full else kept


def run_features(spark: SparkSession, source: str, target: str, **options) -> DataFrame:
    """Write the features in year/month folders and return the table as read back."""
    features = build_features(read_table(spark, source, "timestamp"), **options)
    write_partitioned(features, target, inputs=[source])
    return read_back(spark, target)
