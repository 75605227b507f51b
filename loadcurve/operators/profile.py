"""Distribution and data-quality profiles computed on whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.functions.scalars import finite_or_null, is_missing, label_or, log1p_shifted, nan_to_null, percent
from loadcurve.operators.quantiles import approximate_quantiles, exact_quantiles
from loadcurve.operators.skew import attach, fits_broadcast, join_groups
from loadcurve.session import stored
from loadcurve.sources.tables import require_columns

QUARTILES = (0.25, 0.5, 0.75)
# Measures that physics keeps from being negative.
NON_NEGATIVE_MEASURES = [
    "precipitation", "rain", "snowfall", "snow_depth", "et0_fao_evapotranspiration",
    "sunshine_duration", "direct_radiation", "diffuse_radiation",
]
LOCATION_COLUMNS = ["location_id", "latitude", "longitude", "location"]


def to_long(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value) with every measure as a double; NaN becomes null."""
    measures = [nan_to_null(F.col(f"`{c}`").cast("double")).alias(c) for c in columns]
    return df.select(*by, *measures).unpivot(list(by), list(columns), "column", "value")


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """count, mean, stddev, min, quartiles and max, one row per column (and group).

    ``exact=False`` stops the quantiles after two of four passes.  Missing values are ignored.
    """
    long = to_long(df, columns, by)
    keys = [*by, "column"]
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.mean("value").alias("mean"),
        F.stddev_samp("value").alias("stddev"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    if exact:
        quartiles = exact_quantiles(long, keys, "value", QUARTILES, few_groups=None if by else True)
    else:
        quartiles = approximate_quantiles(long, keys, "value", QUARTILES, few_groups=None if by else True)
    return join_groups(moments, quartiles, keys).select(
        *keys, "count", "mean", "stddev", "min", "q25", "q50", "q75", "max"
    )


def target_counts(df: DataFrame, target: str = "y") -> DataFrame:
    """Row, null and non-positive counts with percentages, in one pass.

    As in the surveyed report NaN counts as valid here; ``describe`` and ``missing_values`` count it
    as missing.
    """
    y = F.col(target)
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(y).alias("n_valid"),
        F.count_if(y.isNull()).alias("n_null"),
        F.count_if(y <= 0).alias("n_non_positive"),
    )
    return counts.select(
        "*",
        percent(F.col("n_null"), F.col("n_rows")).alias("null_pct"),
        percent(F.col("n_non_positive"), F.col("n_valid")).alias("non_positive_pct"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """One row per column: missing count (null, and NaN for floats) and percent of rows."""
    wide = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *(F.count_if(is_missing(df, c)).alias(f"__m{i}") for i, c in enumerate(df.columns)),
    )
    pairs = F.array(
        *(F.struct(F.lit(c).alias("column"), F.col(f"__m{i}").alias("n_missing")) for i, c in enumerate(df.columns))
    )
    return wide.select("__n", F.inline(pairs)).select(
        "column", "n_missing", percent(F.col("n_missing"), F.col("__n")).alias("missing_pct")
    )


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once, with their counts."""
    require_columns(df, *keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def duplicate_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: duplicated combinations, rows in them, and rows beyond the first of each."""
    rows = F.coalesce(F.sum("count"), F.lit(0))
    return duplicate_groups(df, keys).agg(
        F.count(F.lit(1)).alias("n_groups"), rows.alias("n_rows"), (rows - F.count(F.lit(1))).alias("n_extra")
    )


def negative_counts(df: DataFrame, columns: Sequence[str] = tuple(NON_NEGATIVE_MEASURES)) -> DataFrame:
    """Negative values per physically non-negative measure, one pass for all of them."""
    present = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, T.NumericType)]
    if not present:
        raise ValueError("none of the measures is a numeric column")
    wide = df.agg(*(F.count_if(F.col(f"`{c}`") < 0).alias(c) for c in present))
    return wide.unpivot([], present, "column", "n_negative")


def value_counts(df: DataFrame, category: str) -> DataFrame:
    """Rows per category including the null one."""
    return df.groupBy(F.col(category).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def value_shares(df: DataFrame, category: str, digits: int = 2) -> DataFrame:
    """``value_counts`` with the share of all rows in percent."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = value_counts(df, category)
    return counts.withColumn("pct", F.round(percent(F.col("count"), total), digits))


def distinct_values(df: DataFrame, category: str) -> DataFrame:
    """Number of distinct values, counting null as one."""
    return df.select(category).distinct().agg(F.count(F.lit(1)).alias("n_distinct"))


def rows_without_location(df: DataFrame, columns: Sequence[str] = tuple(LOCATION_COLUMNS)) -> DataFrame:
    """Rows in which every location column that exists is null."""
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError("no location column present")
    return df.filter(reduce(Column.__and__, (F.col(c).isNull() for c in present)))


def missing_location_breakdown(
    df: DataFrame,
    by: Sequence[str] = ("dataset", "building_class", "freq"),
    columns: Sequence[str] = tuple(LOCATION_COLUMNS),
) -> DataFrame:
    """Rows without location counted per value of each attribute: (attribute, value, count, pct)."""
    lost = rows_without_location(df, columns)
    present = [c for c in by if c in df.columns]
    long = lost.select(*(F.col(c).cast("string").alias(c) for c in present)).unpivot([], present, "attribute", "value")
    total = lost.agg(F.count(F.lit(1))).scalar()
    counts = long.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("pct", F.round(percent(F.col("count"), total), 2))


def boxplot_stats(
    df: DataFrame, category: str, value: str, missing_label: str | None = None, log_epsilon: float = 1e-6,
    category_order: Sequence[str] | None = None,
) -> DataFrame:
    """Box-plot numbers per category on the original and the log1p scale.

    Whiskers end at the outermost values within 1.5 IQR of the box; the rest are outliers.  The log
    scale covers non-negative values only.  ``category_order`` keeps the named categories alone, in
    that order.  The input is read once, when this is called: its distinct values are counted per
    category into the shared folder, and all passes of the quantiles read those counts.
    """
    shown = label_or(F.col(category), missing_label) if missing_label else F.col(category)
    y = nan_to_null(F.col(value).cast("double"))
    rows = df.select(shown.alias(category), y.alias("__y")).dropna()
    if category_order is not None:
        rows = rows.filter(F.col(category).isin(list(category_order)))
    counted = stored(rows.groupBy(category, "__y").agg(F.count(F.lit(1)).alias("__n")))
    pairs = F.array(
        F.struct(F.lit("original").alias("scale"), F.col("__y").alias("value")),
        F.struct(F.lit("log1p").alias("scale"), log1p_shifted(F.col("__y"), log_epsilon).alias("value")),
    )
    long = counted.select(category, "__n", F.inline(pairs)).filter(F.col("value").isNotNull())
    keys = [category, "scale"]
    few = fits_broadcast(counted.select(category).distinct())
    quartiles = exact_quantiles(long, keys, "value", QUARTILES, few_groups=few, weight="__n")
    boxed = attach(long, quartiles, keys, how="inner", spread_by=["value"], small=few)
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = (F.col("value") >= F.col("q25") - reach) & (F.col("value") <= F.col("q75") + reach)
    boxes = boxed.groupBy(*keys, "q25", "q50", "q75").agg(
        F.sum("__n").alias("count"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("__n"))).cast("long").alias("n_outliers"),
    )
    if category_order is None:
        return boxes
    return boxes.orderBy(F.array_position(F.lit(list(category_order)), F.col(category)), F.desc("scale"))


def histogram(df: DataFrame, column: str, bins: int = 30, scale: str = "original") -> DataFrame:
    """Equal-width bins over the range of the finite values, empty ones included; the last is closed.

    A constant column gets one unit of width around its value.  ``scale="log1p"`` bins log(1 + x).
    """
    x = finite_or_null(F.col(column).cast("double"))
    if scale == "log1p":
        x = finite_or_null(F.log1p(x))
    values = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    low, high = F.min("x"), F.max("x")
    flat = low == high
    limits = values.agg(
        F.when(flat, low - 0.5).otherwise(low).alias("lo"), F.when(flat, high + 0.5).otherwise(high).alias("hi")
    )
    span = limits.select(F.struct("lo", "hi")).scalar()
    bin_of = F.least(F.width_bucket("x", span["lo"], span["hi"], F.lit(bins)), F.lit(bins).cast("long"))
    counts = values.groupBy(bin_of.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    edges = limits.filter(F.col("lo").isNotNull()).select(
        "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    )
    return edges.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_start"),
        (F.col("lo") + F.col("bin") * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def location_density(df: DataFrame, latitude: str = "latitude", longitude: str = "longitude", digits: int = 1) -> DataFrame:
    """Rows per rounded coordinate cell."""
    cells = df.dropna(subset=[latitude, longitude]).select(
        F.round(latitude, digits).alias("lat"), F.round(longitude, digits).alias("lon")
    )
    return cells.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("count"))
