"""Joins between readings, entity metadata and located observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcurve.operators.skew import BROADCAST_ROWS, align, attach
from loadcurve.session import stored

# Bits of the bitmap that tells which rows may match: 16 MB.
FILTER_BITS = 1 << 27
METADATA_COLUMNS = ("unique_id", "location_id", "building_class", "cluster_size")


def join_metadata(
    demand: DataFrame,
    metadata: DataFrame,
    columns: Sequence[str] | None = None,
    key: str = "unique_id",
    timestamp: str = "timestamp",
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add metadata columns to every reading; readings without metadata are kept."""
    wanted = [c for c in (columns or metadata.columns) if c in metadata.columns and c != key]
    spread = [timestamp] if timestamp in demand.columns else [c for c in demand.columns if c != key]
    return attach(demand, metadata.select(key, *wanted), [key], spread_by=spread, max_broadcast_rows=max_broadcast_rows)


def join_located(
    demand: DataFrame,
    metadata: DataFrame,
    columns: Sequence[str] = ("location_id",),
    key: str = "unique_id",
    location: str = "location_id",
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the location, keeping only readings that have one.

    A left join followed by a not-null test on the right side is an inner join; it is written as one.
    """
    right = metadata.select(key, *columns).filter(F.col(location).isNotNull())
    spread = [c for c in demand.columns if c != key]
    return attach(demand, right, [key], how="inner", spread_by=spread, max_broadcast_rows=max_broadcast_rows)


def join_weather(
    readings: DataFrame,
    weather: DataFrame,
    location: str = "location_id",
    timestamp: str = "timestamp",
    unit: str = "hour",
    key: str = "unique_id",
    size_bound: DataFrame | None = None,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the observation of the reading's location and truncated time; keep every reading.

    One location and one timestamp column (the reading's) remain.  ``size_bound`` is as in ``align``.
    """
    keys = [(F.col(location), location), (F.date_trunc(unit, F.col(timestamp)), timestamp)]
    return align(readings, weather, keys, spread_by=[key, timestamp], size_bound=size_bound, max_broadcast_rows=max_broadcast_rows)


def join_weather_truncated(
    readings: DataFrame,
    weather: DataFrame,
    measures: Sequence[str],
    location: str = "location_id",
    timestamp: str = "timestamp",
    unit: str = "hour",
    size_bound: DataFrame | None = None,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Like ``join_weather`` with both sides truncated and the truncated time kept as ``timestamp_<unit>``."""
    stamp = f"timestamp_{unit}"
    left = readings.withColumn(stamp, F.date_trunc(unit, F.col(timestamp))).filter(F.col(stamp).isNotNull())
    right = (
        weather.withColumn(stamp, F.date_trunc(unit, F.col(timestamp)))
        .filter(F.col(stamp).isNotNull())
        .select(location, stamp, *measures)
    )
    keys = [(F.col(location), location), (F.col(stamp), stamp)]
    spread = [c for c in readings.columns if c != location]
    return align(left, right, keys, spread_by=spread, size_bound=size_bound, max_broadcast_rows=max_broadcast_rows)


def keys_in_both(left: DataFrame, right: DataFrame, key: str = "location_id") -> DataFrame:
    """Distinct keys present on both sides (a null key matches nothing)."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "inner")


def keys_only_left(left: DataFrame, right: DataFrame, key: str = "location_id") -> DataFrame:
    """Distinct keys of the left side absent from the right (a null key counts as absent)."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def compare_ranges(left: DataFrame, right: DataFrame, key: str = "location_id") -> DataFrame:
    """Full outer join of two per-key range tables, in no order."""
    return left.join(right, key, "outer")


def possible_rows(reference: DataFrame, keys: DataFrame, on: Sequence[str], bits: int = FILTER_BITS) -> DataFrame:
    """Rows of the reference table that may hold one of the keys, by a bitmap of the keys' hashes.

    The bitmap, ``bits / 8`` bytes however many keys there are, is built by map-side combined aggregation in
    parts of 4 KB and broadcast.  Rows without any of the keys are dropped at the scan, up to chance hits.
    """
    types = [(keys.schema[c].dataType, reference.schema[c].dataType) for c in on]

    def place(other_first: bool) -> Column:
        columns = (
            F.col(f"`{c}`") if a == b else F.coalesce(F.col(f"`{c}`"), F.lit(None).cast(b if other_first else a)) for c, (a, b) in zip(on, types)
        )
        return F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1

    bitmap = (
        keys.dropna(subset=list(on)).select(place(True).alias("__place"))
        .groupBy(F.bitmap_bucket_number("__place").alias("__bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__place")).alias("__bitmap"))
    )
    bit = F.bitmap_bit_position("__place")
    placed = reference.withColumn("__place", place(False)).withColumns(
        {"__bucket": F.bitmap_bucket_number("__place"), "__byte": F.shiftright(bit, 3).cast("int"), "__bit": bit.bitwiseAND(7).cast("int")}
    )
    is_set = "shiftright(cast(conv(hex(substring(__bitmap, __byte + 1, 1)), 16, 10) as int), __bit) & 1 = 1"
    found = placed.join(F.broadcast(bitmap), "__bucket").filter(is_set)
    return found.select(*(F.col(f"`{c}`") for c in reference.columns))


def _distinct_matches(keys: DataFrame, reference: DataFrame, on: Sequence[str]) -> DataFrame:
    """The reference's different keys that can match, so that a key with many rows there travels once."""
    return possible_rows(reference.select(*on), keys, on).distinct()


def existing_keys(keys: DataFrame, reference: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that do occur in the reference table.  They are stored first, since the filter and the join both need them."""
    keys = stored(keys)
    return keys.join(_distinct_matches(keys, reference, on), list(on), "left_semi")


def absent_keys(keys: DataFrame, reference: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that do not occur in the reference table; stored first as well."""
    keys = stored(keys)
    return keys.join(_distinct_matches(keys, reference, on), list(on), "left_anti")
