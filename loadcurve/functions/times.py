"""Timestamp normalisation and calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Display names and display order.
WEEKDAY_NAMES = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]  # dayofweek 1..7
WEEKDAY_DISPLAY_ORDER = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

CALENDAR_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "dayofweek": F.dayofweek,
    "dayofyear": F.dayofyear,
    "hour": F.hour,
}


def as_timestamp(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Turn a string or zone-free timestamp column into a zoned timestamp.

    Unparsable strings become null (``parse_report`` counts them); any other type is an error.
    """
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.TimestampType):
        return df
    if isinstance(dtype, T.StringType):
        return df.withColumn(column, F.try_to_timestamp(F.col(column)))
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return df.withColumn(column, F.col(column).cast("timestamp"))
    raise TypeError(f"column {column!r} has type {dtype.simpleString()}, expected a timestamp or string")


def drop_unparsed(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Normalise the timestamp, then drop the rows that have none."""
    return as_timestamp(df, column).dropna(subset=[column])


def parse_report(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """One row: rows read, rows kept and rows lost to missing or unparsable timestamps."""
    parsed = as_timestamp(df, column)
    return parsed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(column).alias("n_kept"),
        (F.count(F.lit(1)) - F.count(column)).alias("n_dropped"),
    )


def truncate_to_hour(column: Column | str) -> Column:
    return F.date_trunc("hour", column)


def is_on_hour(column: str) -> Column:
    """True where minute, second and fraction are all zero."""
    return F.col(column) == F.date_trunc("hour", F.col(column))


def epoch_seconds(column: Column | str) -> Column:
    return F.unix_seconds(column)


def calendar_features(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Append year, month, day, dayofweek (Sunday = 1), dayofyear and hour."""
    df = as_timestamp(df, column)
    return df.withColumns({name: part(F.col(column)) for name, part in CALENDAR_PARTS.items()})


def weekday_name(dayofweek: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAY_NAMES)), F.col(dayofweek) if isinstance(dayofweek, str) else dayofweek)


def month_name(month: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.col(month) if isinstance(month, str) else month)


def display_position(label: Column | str, order: list[str]) -> Column:
    """1-based place of a label in a display order, 0 if it is not listed."""
    return F.array_position(F.array(*map(F.lit, order)), F.col(label) if isinstance(label, str) else label)
