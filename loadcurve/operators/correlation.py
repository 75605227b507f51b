"""Pearson correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcurve.operators.filters import complete_cases, having_ids
from loadcurve.operators.joins import join_located, join_weather_truncated
from loadcurve.operators.sampling import sample_ids
from loadcurve.functions.scalars import to_number

# The measures of the two correlation reports.
MATRIX_MEASURES = [
    "temperature_2m", "relative_humidity_2m", "dew_point_2m", "apparent_temperature", "precipitation",
    "rain", "snowfall", "snow_depth", "pressure_msl", "surface_pressure", "cloud_cover",
    "cloud_cover_low", "cloud_cover_mid", "cloud_cover_high", "et0_fao_evapotranspiration",
    "vapour_pressure_deficit", "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m",
    "soil_temperature_0_to_7cm", "soil_moisture_0_to_7cm", "sunshine_duration",
    "shortwave_radiation", "direct_radiation", "diffuse_radiation", "direct_normal_irradiance",
    "terrestrial_radiation",
]
DEMAND_MEASURES = [
    "temperature_2m", "relative_humidity_2m", "apparent_temperature", "precipitation", "wind_speed_10m",
    "cloud_cover",
]


def correlation_matrix(df: DataFrame, columns: Sequence[str] = tuple(MATRIX_MEASURES)) -> DataFrame:
    """(i, j, column_i, column_j, r) over the complete rows of the columns that exist.

    One lazy aggregation: a complete row yields one record per column, which is correlated with all
    columns at once; the k records of a task's rows are combined before the shuffle.
    """
    present = [c for c in columns if c in df.columns]
    if len(present) < 2:
        raise ValueError("a correlation needs at least two of the columns")
    numbers = complete_cases(df.select(*(to_number(F.col(f"`{c}`")).alias(c) for c in present)))
    values = [F.col(f"`{c}`") for c in present]
    each = F.posexplode(F.array(*values)).alias("i", "__x")
    rows = numbers.select(*present, each).groupBy("i").agg(
        *(F.corr("__x", v).alias(f"__r{j}") for j, v in enumerate(values))
    )
    cells = F.array(*(F.struct(F.lit(j).alias("j"), F.col(f"__r{j}").alias("r")) for j in range(len(present))))
    names = F.array(*(F.lit(c) for c in present))
    return rows.select("i", F.inline(cells)).select(
        "i", "j", F.get(names, "i").alias("column_i"), F.get(names, "j").alias("column_j"),
        # a column agrees with itself exactly
        F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("r")).alias("r"),
    )


def strong_pairs(matrix: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Different columns with |r| above the threshold, each pair once."""
    pairs = matrix.filter((F.col("i") < F.col("j")) & (F.abs("r") > threshold))
    return pairs.select("column_i", "column_j", "r").orderBy(F.desc("r"), "column_i", "column_j")


def correlate_with(df: DataFrame, target: str, measures: Sequence[str]) -> DataFrame:
    """(measure, r) of the target with each measure over complete rows, in one aggregation."""
    numbers = df.select(*(to_number(F.col(c)).alias(c) for c in [target, *measures]))
    wide = complete_cases(numbers).agg(*(F.corr(target, m).alias(m) for m in measures))
    return wide.unpivot([], list(measures), "measure", "r")


def demand_weather_correlation(
    demand: DataFrame,
    metadata: DataFrame,
    weather: DataFrame,
    measures: Sequence[str] = tuple(DEMAND_MEASURES),
    n_ids: int | None = None,
    seed: int = 42,
    unit: str = "hour",
    target: str = "y",
    size_bound: DataFrame | None = None,
) -> DataFrame:
    """Correlation of demand with weather at the same place and time.

    Every series counts, unless ``n_ids`` asks for a sample of so many from the metadata.
    """
    if n_ids is not None:
        ids = sample_ids(metadata, "unique_id", n_ids, seed)
        demand = having_ids(demand, ids)
        metadata = having_ids(metadata, ids)
    located = join_located(demand.select("unique_id", "timestamp", target), metadata)
    joined = join_weather_truncated(located, weather, list(measures), unit=unit, size_bound=size_bound)
    return correlate_with(joined, target, measures)
