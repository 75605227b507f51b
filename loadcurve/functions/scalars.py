"""Scalar expressions that are safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN for float and double columns (``isnan`` is an error on other types)."""
    value = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; null where the whole is zero."""
    return F.try_divide(F.lit(100.0) * part, whole)


def nan_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(float("nan")))


def finite_or_null(value: Column) -> Column:
    """Drop NaN and both infinities, keep everything else."""
    infinite = value.isin(float("inf"), float("-inf"))
    return F.when(~(F.isnan(value) | infinite), value)


def to_number(value: Column) -> Column:
    """Numeric coercion; text that is no number becomes null."""
    return value.try_cast("double")


def log1p_shifted(value: Column, epsilon: float = 1e-6) -> Column:
    """log(1 + value + epsilon) for valid non-negative values, else null.

    NaN compares greater than every number, so it is excluded explicitly.
    """
    return F.when((value >= 0) & ~F.isnan(value), F.log1p(value + F.lit(epsilon)))


def label_or(value: Column, label: str) -> Column:
    """Text form of a category with nulls shown as ``label``."""
    return F.coalesce(value.cast("string"), F.lit(label))


def as_interval(seconds: Column) -> Column:
    """Seconds as a day-time interval for display."""
    return F.make_dt_interval(secs=seconds)
