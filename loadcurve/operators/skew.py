"""Joins and series layouts that hold up when one key owns much of the data."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.session import stored

# A side is broadcast only if it stays within both; see ``fits_broadcast``.
BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 64 << 20
# A key is hot if it has more than this share of an average task's rows, and is then cut into parts
# of that share: many small parts fall more evenly than a few large ones.
HOT_SHARE = 0.5
PART_SHARE = 1 / 16
# Parts of the first level when summaries of frequent keys are merged.
MERGE_GROUPS = 64
# A series longer than this (a century of hourly records is 876,600) is cut into chunks of about
# this many rows before windowing.
MAX_SERIES_ROWS = 1_000_000
# Long series named by literals; beyond that many they are joined.
LISTED_KEYS = 1_000


def row_bytes(df: DataFrame) -> Column:
    """About how much a row takes: lengths of texts and binaries as they are, nested values by their JSON."""
    width = F.lit(16)
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width += F.coalesce(F.octet_length(column), F.lit(0)) + 16
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width += F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 16
        else:
            width += 16 if isinstance(field.dataType, T.DecimalType) else 8
    return width.cast("long")


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure at most ``max_rows + 1`` rows to learn whether the side is small in rows and in bytes.

    Only the widths of the rows are brought together, not the rows.
    """
    widths = df.select(row_bytes(df).alias("w")).limit(max_rows + 1)
    rows, size = widths.agg(F.count("w"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def hot_keys(hashes: DataFrame, tasks: int) -> list[tuple[int, int]]:
    """(key hash, parts) of every hash that has more than ``HOT_SHARE`` of an average task's rows.

    ``hashes`` has one long column.  Frequent values are found by mergeable summaries with a bounded number
    of counters, combined map-side and merged in two levels; no key is shuffled.  Their counts are
    upper bounds, so a key may be cut into more parts than it needs but no hot one is missed.  At most
    ``2 * tasks`` keys reach the driver.
    """
    column = hashes.columns[0]
    most = math.ceil(tasks / HOT_SHARE)
    counters = min(max(10_000, 16 * most), 1_000_000)
    states = hashes.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS))).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(`{column}`, {counters})").alias("state")
    )
    merged = states.groupBy(F.lit(0).alias("all")).agg(
        F.sum("n").alias("n"), F.expr(f"approx_top_k_estimate(approx_top_k_combine(state, {counters}), {most})").alias("found")
    )
    row = merged.first()  # none without rows
    if row is None:
        return []
    part = max(row["n"] / tasks * PART_SHARE, 1)
    return [(item["item"], math.ceil(item["count"] / part)) for item in row["found"] if item["count"] > HOT_SHARE / PART_SHARE * part]


def _counted_hot_keys(counts: DataFrame, tasks: int) -> list[tuple[int, int]]:
    """As ``hot_keys`` from (key hash, rows); fewer than ``tasks / HOT_SHARE`` keys can be hot."""
    counts = counts.toDF("h", "n")
    part = max((counts.agg(F.sum("n")).first()[0] or 0) / tasks * PART_SHARE, 1)
    return [(h, math.ceil(n / part)) for h, n in counts.filter(F.col("n") > HOT_SHARE / PART_SHARE * part).collect()]


def _hash(columns: Sequence[Column], others: Sequence[Column], types: Sequence[tuple[T.DataType, T.DataType]]) -> Column:
    """A hash that equal keys of two sides share, whatever their types."""
    common = (c if a == b else F.coalesce(c, F.lit(None).cast(b)) for c, (a, b) in zip(columns, types))
    return F.xxhash64(*common)


def _parts(key_hash: Column, hot: Sequence[tuple[int, int]]) -> Column:
    """Number of parts of a row's key, rounded up to a power of two; one test of membership per power."""
    by_power: dict[int, list[int]] = {}
    for found, parts in hot:
        by_power.setdefault(1 << (parts - 1).bit_length(), []).append(found)
    chosen = F.lit(1)
    for power, hashes in by_power.items():
        chosen = F.when(key_hash.isin(hashes), power).otherwise(chosen)
    return chosen


def split_hot_keys(
    left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], spread_by: Sequence[str],
    null_safe: bool = False, tasks: int | None = None, counts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``__salt`` that must be equal too when they are joined.

    Each hot key of the left side gets its own number of salts, and its rows on the right that many
    copies; all other keys have salt 0 and one copy.  Left rows with a null key, which match nothing unless
    ``null_safe``, are scattered.  ``tasks`` defaults to the number of shuffle partitions.
    ``counts``, rows of the left keys with their number in the last column, saves looking for hot ones.
    """
    tasks = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lc, rc = ([F.col(f"`{k}`") for k in keys] for keys in (left_keys, right_keys))
    types = [(left.schema[a].dataType, right.schema[b].dataType) for a, b in zip(left_keys, right_keys)]
    of_left = _hash(lc, rc, types)
    of_right = _hash(rc, lc, [(b, a) for a, b in types])
    unmatched = F.lit(False) if null_safe else F.greatest(*(c.isNull() for c in lc), F.lit(False))
    scattered = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in spread_by)), F.lit(int(tasks / PART_SHARE))).cast("int")
    usual = F.when(unmatched, scattered).otherwise(0)

    if counts is None:
        hot = hot_keys(left.filter(~unmatched).select(of_left.alias("h")), tasks)
    else:
        hot = _counted_hot_keys(counts.select(_hash([F.col(f"`{k}`") for k in left_keys], rc, types), counts.columns[-1]), tasks)
    if not hot:
        zero = F.pmod(of_right, F.lit(1)).cast("int")  # always 0, but derived from a column so that it stays a hash key
        return left.withColumn("__salt", usual), right.withColumn("__salt", zero)
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), _parts(of_right, hot) - 1)))
    spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in spread_by)), _parts(of_left, hot)).cast("int")
    return left.withColumn("__salt", F.when(unmatched, scattered).otherwise(spread)), right


def _equal(left: Column, right: Column, null_safe: bool) -> Column:
    return left.eqNullSafe(right) if null_safe else left == right


def attach(
    fact: DataFrame,
    dimension: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] = (),
    null_safe: bool = False,
    small: bool | None = None,
    max_broadcast_rows: int = BROADCAST_ROWS,
    tasks: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Left or inner join of a large fact with a much smaller side, safe for hot keys.

    A side of checked small size is broadcast, so the fact is not shuffled at all.  Beyond that, hot keys
    of the fact are cut by a hash of ``spread_by`` (see ``split_hot_keys``); cold keys are not copied.
    ``small`` states whether the dimension is known to be small; if left open it is measured.
    ``counts`` is as in ``split_hot_keys``.
    """
    if how not in ("left", "inner"):
        raise ValueError("attach supports left and inner joins")
    kept, added = list(fact.columns), [c for c in dimension.columns if c not in keys]
    if small is None:
        small = fits_broadcast(dimension, max_broadcast_rows)
    if not small and spread_by:
        fact, dimension = split_hot_keys(fact, dimension, keys, keys, spread_by, null_safe, tasks, counts)
    left, right = fact.alias("l"), dimension.alias("r")
    on = [_equal(F.col(f"l.`{k}`"), F.col(f"r.`{k}`"), null_safe) for k in keys]
    if small:
        right = F.broadcast(right)
    elif spread_by:
        on.append(F.col("l.__salt") == F.col("r.__salt"))
    return left.join(right, on, how).select(*(F.col(f"l.`{c}`") for c in kept), *(F.col(f"r.`{c}`") for c in added))


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of two aggregates with one row per group each; null groups match."""
    l, r = left.alias("l"), right.alias("r")
    on = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]
    return l.join(r, on).select("l.*", *(F.col(f"r.`{c}`") for c in right.columns if c not in keys))


def align(
    fact: DataFrame,
    observed: DataFrame,
    keys: Sequence[tuple[Column, str]],
    spread_by: Sequence[str],
    how: str = "left",
    size_bound: DataFrame | None = None,
    max_broadcast_rows: int = BROADCAST_ROWS,
    tasks: int | None = None,
) -> DataFrame:
    """Left join of readings with observations on composite, possibly computed, keys.

    ``keys`` pairs an expression over ``fact`` with a column of ``observed``; the observed key
    columns are left out of the result.  The observations are broadcast if ``size_bound``, a frame with
    at least as many rows that is cheap to measure (such as the table before de-duplication), is small.
    Beyond that hot keys, say an hour of a location with very many series, are cut, and fact rows with a
    null key, which match nothing, are scattered.
    """
    names, theirs = ([f"__{side}{i}" for i in range(len(keys))] for side in ("k", "o"))
    left = fact.withColumns({n: expr for n, (expr, _) in zip(names, keys)})
    measures = [c for c in observed.columns if c not in {o for _, o in keys}]
    right = observed.select(
        *(F.col(f"`{o}`").alias(n) for n, (_, o) in zip(theirs, keys)), *(F.col(f"`{m}`") for m in measures)
    )
    on = [F.col(n) == F.col(o) for n, o in zip(names, theirs)]
    if fits_broadcast(observed if size_bound is None else size_bound, max_broadcast_rows):
        right = F.broadcast(right)
    else:
        left, right = split_hot_keys(left, right, names, theirs, spread_by, tasks=tasks)
        left, right = left.withColumnRenamed("__salt", "__salt_l"), right.withColumnRenamed("__salt", "__salt_r")
        on.append(F.col("__salt_l") == F.col("__salt_r"))
    joined = left.join(right, on, how)
    return joined.select(*(F.col(f"`{c}`") for c in fact.columns), *(F.col(f"`{m}`") for m in measures))


@dataclass(frozen=True)
class SeriesLayout:
    """Rows ready for ``Window.partitionBy(*partition_by).orderBy(*order_by)``.

    In a cut series each chunk carries copies of the rows that precede it; ``own_rows`` drops
    those copies after the window has been computed.
    """

    frame: DataFrame
    partition_by: list[str]
    order_by: list[str]
    cut: bool

    def own_rows(self, computed: DataFrame) -> DataFrame:
        return computed.filter(~F.col("__halo")).drop("__chunk", "__halo", "__position") if self.cut else computed


def _mark_long_series(df: DataFrame, key: str, timestamp: str, max_rows: int) -> DataFrame | None:
    """Flag rows of series longer than ``max_rows`` as ``__long``; None if there is no such series.

    At most total / max_rows keys are long.  Up to ``LISTED_KEYS`` of them are fetched and tested as
    literals, more are joined.
    """
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > max_rows).select(key)
    found = [row[0] for row in counted.limit(LISTED_KEYS + 1).collect()]
    if not found:
        return None
    if len(found) > LISTED_KEYS:
        flagged = attach(df, counted.withColumn("__long", F.lit(True)), [key], spread_by=[timestamp], null_safe=True)
        return flagged.withColumn("__long", F.coalesce("__long", F.lit(False)))
    listed = F.coalesce(F.col(key).isin([k for k in found if k is not None]), F.lit(False))
    return df.withColumn("__long", listed | F.col(key).isNull() if None in found else listed)


def lay_out_by_rows(
    df: DataFrame,
    key: str,
    timestamp: str,
    preceding_rows: int,
    max_series_rows: int = MAX_SERIES_ROWS,
    tiebreak: Sequence[str] = (),
) -> SeriesLayout:
    """Cut long series into chunks of ``max_series_rows`` consecutive rows, each led by those its frames reach back to.

    Only keys are scanned to find long series; without any, the frame is returned untouched.
    Long ones are stored once in range partitions by series and time.  The partitions' row counts, added up,
    give every row its position in its series, so chunks are cut by rows even where a series has most of
    them within one hour or at one instant, and no partition holds a whole series.
    """
    order = [timestamp, *tiebreak]
    marked = _mark_long_series(df, key, timestamp, max_series_rows)
    if marked is None:
        return SeriesLayout(df, [key], order, cut=False)
    size = max(max_series_rows, preceding_rows, 1)
    # rows that are equal in key and order are told apart by all they hold, so that they can be split too
    rest = [c for c, t in df.dtypes if c not in (key, *order) and "map<" not in t and "variant" not in t]
    sort = [key, *order, *([F.xxhash64(*(f"`{c}`" for c in rest))] if rest else [])]
    long = marked.filter("__long").drop("__long").repartitionByRange(*sort).sortWithinPartitions(*sort)
    long = stored(long.withColumn("__at", F.monotonically_increasing_id()))
    # the number has the partition in its upper bits, the row in the lower 33
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    parts = long.groupBy(key, part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"), F.min(row).alias("__first"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(
        parts.select(
            key,
            "__part",
            (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
            (F.sum("__rows").over(Window.partitionBy(key)) - 1).alias("__last"),
        )
    )
    placed = attach(long.withColumn("__part", part), parts, [key, "__part"], spread_by=["__at"], null_safe=True)
    position = F.col("__shift") + row
    own = F.floor(position / F.lit(size))
    chunks = F.sequence(own, F.floor(F.least(position + preceding_rows, F.col("__last")) / F.lit(size)))
    columns = [F.col(f"`{c}`") for c in df.columns]
    cut = placed.select(*columns, position.alias("__position"), own.alias("__home"), F.explode(chunks).alias("__chunk"))
    cut = cut.select(*columns, "__position", "__chunk", (F.col("__chunk") != F.col("__home")).alias("__halo"))
    whole = marked.filter(~F.col("__long")).select(
        *columns, F.lit(None).cast("long").alias("__position"), F.lit(0).cast("long").alias("__chunk"), F.lit(False).alias("__halo")
    )
    return SeriesLayout(whole.unionByName(cut), [key, "__chunk"], [*order, "__position"], cut=True)


def lay_out_by_time(
    df: DataFrame,
    key: str,
    timestamp: str,
    preceding_seconds: int,
    max_series_rows: int = MAX_SERIES_ROWS,
    chunk_seconds: int | None = None,
) -> SeriesLayout:
    """Like ``lay_out_by_rows`` for frames that reach back a fixed time instead of a row count.

    Chunks of long series are fixed time slices no shorter than the reach, so a row is needed in
    its own slice and at most in the next one.
    """
    marked = _mark_long_series(df, key, timestamp, max_series_rows)
    if marked is None:
        return SeriesLayout(df, [key], [timestamp], cut=False)
    width = max(chunk_seconds or 8 * preceding_seconds, preceding_seconds, 1)
    seconds = F.unix_seconds(F.col(timestamp))
    own = F.when(F.col("__long"), F.floor(seconds / F.lit(width)))
    reaches_next = (own + 1) * F.lit(width) - seconds <= F.lit(preceding_seconds)
    targets = (
        F.when(own.isNull(), F.array(F.lit(0).cast("long")))
        .when(reaches_next, F.array(own, own + 1))
        .otherwise(F.array(own))
    )
    cut = (
        marked.select(*df.columns, F.coalesce(own, F.lit(0)).alias("__home"), F.explode(targets).alias("__chunk"))
        .withColumn("__halo", F.col("__chunk") != F.col("__home"))
        .drop("__home")
    )
    return SeriesLayout(cut, [key, "__chunk"], [timestamp], cut=True)
