"""Column selection and shaping."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that identify a row or are the target, never features.
NON_FEATURES = ("y", "unique_id", "timestamp", "location_id")


def prune(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Keep the listed columns that exist, in the listed order."""
    return df.select(*(c for c in columns if c in df.columns))


def derive(
    df: DataFrame,
    new: Mapping[str, Column] | None = None,
    rename: Mapping[str, str] | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Add, rename and drop columns in one projection."""
    return df.withColumns(dict(new or {})).withColumnsRenamed(dict(rename or {})).drop(*drop)


def join_keep_left(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "left") -> DataFrame:
    """Join and keep the left copy of every column that both sides have."""
    l, r = left.alias("l"), right.alias("r")
    condition = [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in on]
    dropped = {b for _, b in on} | set(left.columns)
    return l.join(r, condition, how).select("l.*", *(F.col(f"r.{c}") for c in right.columns if c not in dropped))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = NON_FEATURES, requested: Iterable[str] | None = None) -> list[str]:
    """Numeric columns of the schema, optionally narrowed to a requested list (whose order wins)."""
    excluded = set(exclude)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in excluded]
    return numeric if requested is None else [c for c in requested if c in set(numeric)]
