"""Reading tables, checking their contract and describing them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.functions.times import as_timestamp

# The weather measures and codes of the input contract.
WEATHER_MEASURES = [
    "temperature_2m", "relative_humidity_2m", "dew_point_2m", "apparent_temperature",
    "precipitation", "rain", "snowfall", "snow_depth", "pressure_msl", "surface_pressure",
    "cloud_cover", "cloud_cover_low", "cloud_cover_mid", "cloud_cover_high",
    "et0_fao_evapotranspiration", "vapour_pressure_deficit", "wind_speed_10m",
    "wind_direction_10m", "wind_gusts_10m", "soil_temperature_0_to_7cm",
    "soil_temperature_7_to_28cm", "soil_moisture_0_to_7cm", "soil_moisture_7_to_28cm",
    "sunshine_duration", "shortwave_radiation", "direct_radiation", "diffuse_radiation",
    "direct_normal_irradiance", "terrestrial_radiation",
]
WEATHER_CODES = ["is_day", "weather_code"]


@dataclass(frozen=True)
class Contract:
    """Required columns of a role, each with the accepted type families."""

    role: str
    columns: dict[str, tuple[type, ...]] = field(default_factory=dict)


_TIME = (T.TimestampType, T.TimestampNTZType, T.StringType)
_KEY = (T.StringType, T.IntegerType, T.LongType)

DEMAND = Contract("demand", {"unique_id": _KEY, "timestamp": _TIME, "y": (T.NumericType,)})
METADATA = Contract("metadata", {"unique_id": _KEY, "location_id": _KEY})
WEATHER = Contract("weather", {"location_id": _KEY, "timestamp": _TIME})


def read_table(spark: SparkSession, path: str, time_column: str | None = None) -> DataFrame:
    """Read Parquet; normalise the named time column."""
    df = spark.read.parquet(path)
    return as_timestamp(df, time_column) if time_column else df


def load_tables(
    spark: SparkSession, demand_path: str, metadata_path: str, weather_path: str, time_column: str = "timestamp"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three inputs, timestamps normalised and contracts checked."""
    demand = read_table(spark, demand_path, time_column)
    metadata = read_table(spark, metadata_path)
    weather = read_table(spark, weather_path, time_column)
    for df, contract in ((demand, DEMAND), (metadata, METADATA), (weather, WEATHER)):
        check_contract(df, contract)
    return demand, metadata, weather


def contract_problems(df: DataFrame, contract: Contract, require_rows: bool = False) -> list[str]:
    """What keeps ``df`` from serving as the given role; empty when nothing does."""
    present = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for name, families in contract.columns.items():
        if name not in present:
            problems.append(f"missing column {name}")
        elif not isinstance(present[name], families):
            problems.append(f"column {name} has type {present[name].simpleString()}")
    if require_rows and df.isEmpty():
        problems.append("no rows")
    return problems


def check_contract(df: DataFrame, contract: Contract, require_rows: bool = False) -> DataFrame:
    problems = contract_problems(df, contract, require_rows)
    if problems:
        raise ValueError(f"{contract.role}: " + "; ".join(problems))
    return df


def require_columns(df: DataFrame, *names: str) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")


def table_profile(tables: dict[str, DataFrame], partitions: bool = False) -> DataFrame:
    """One row per table: row and column counts (a table's rows are counted in one pass).

    ``partitions`` adds how many partitions hold rows; it depends on files and session, not on the data.
    """
    parts = [F.count_distinct("__part").alias("n_partitions")] if partitions else []
    rows = [
        (df.withColumn("__part", F.spark_partition_id()) if partitions else df).agg(F.count(F.lit(1)).alias("n_rows"), *parts).select(
            F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_cols"), *["n_partitions"] * partitions
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """A bounded look at the first rows."""
    return df.limit(n)
