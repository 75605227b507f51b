"""Registry that keeps each query next to its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixtures import BASE_SQL, Tables
from loadcurve.session import pin_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
# What must hold for the rows of a query that SQL cannot express.
INVARIANTS: dict[str, Callable[[list[dict], SparkSession, str], bool]] = {}


def zone_free(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the SQL side has them."""
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(f"`{c}`").cast("timestamp_ntz") for c in stamps}) if stamps else df


def check(name: str, sql: str | None = None, holds: Callable[[list[dict], Tables], bool] | None = None):
    """Register a query with its SQL or with an invariant of its rows.

    ``sql`` continues the shared table expressions (``, more AS (...) SELECT ...``).
    """
    if (sql is None) == (holds is None):
        raise ValueError(f"{name} needs either SQL or an invariant")

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_utc(spark)
            return zone_free(build(Tables(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = BASE_SQL + sql
        else:
            INVARIANTS[name] = lambda rows, spark, sf_dir: holds(rows, Tables(spark, sf_dir))
        return build

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round float results, whose last bits depend on summation order."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in names})
