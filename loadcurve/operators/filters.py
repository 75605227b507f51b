"""Row predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcurve.functions.scalars import is_missing
from loadcurve.operators.skew import broadcast_if_small


def with_target(df: DataFrame, target: str = "y") -> DataFrame:
    """Rows whose target is known."""
    return df.filter(F.col(target).isNotNull())


def without_initial_window(df: DataFrame, max_window: int, target: str = "y", mode: str = "null") -> DataFrame:
    """Drop the start of each series, where the widest rolling frame is not filled.

    ``null`` keeps every row whose widest rolling mean is non-null, which a partly filled frame
    already satisfies.  ``full`` asks for a complete frame and needs the ``rows`` statistic.
    """
    if mode == "null":
        column = f"{target}_rolling_mean_{max_window}h"
        return df.filter(F.col(column).isNotNull()) if column in df.columns else df
    if mode == "full":
        return df.filter(F.col(f"{target}_rolling_rows_{max_window}h") >= max_window)
    raise ValueError("mode is 'null' or 'full'")


def with_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows where all the listed keys are non-null."""
    return df.dropna(subset=list(keys))


def non_positive(df: DataFrame, column: str = "y") -> DataFrame:
    return df.filter(F.col(column) <= 0)


def negative(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) < 0)


def having_ids(df: DataFrame, ids: DataFrame | Sequence, key: str = "unique_id") -> DataFrame:
    """Rows of the listed ids, given as a short literal list or as a frame."""
    if isinstance(ids, DataFrame):
        return df.join(broadcast_if_small(ids.select(key)), key, "left_semi")
    return df.filter(F.col(key).isin(list(ids)))


def missing_observation(measure: str, location: str = "location_id", exclude: Sequence[str] = ()) -> Column:
    """Measure absent although the location is known and not among the excluded ones."""
    condition = F.col(measure).isNull() & F.col(location).isNotNull()
    return condition & ~F.col(location).isin(list(exclude)) if exclude else condition


def valid_for_log(value: str, category: str) -> Column:
    """Non-negative, not NaN, and with a category (NaN >= 0 holds, hence the extra test)."""
    return (F.col(value) >= 0) & ~F.isnan(F.col(value)) & F.col(category).isNotNull()


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null or NaN in the given columns (all columns by default).

    Written as plain null tests, which reach the scan and turn a preceding left join into an inner one.
    """
    for c in columns or df.columns:
        df = df.filter(~is_missing(df, c))
    return df


def in_top_categories(df: DataFrame, top: DataFrame, category: str) -> DataFrame:
    """Rows whose category is in a top-N frame, which Spark broadcasts if its size allows."""
    return df.join(top.select(category), category, "left_semi")
