"""Row samples and whole-series samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcurve.functions.scalars import percent
from loadcurve.operators.skew import BROADCAST_ROWS


def sample_rows(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Seeded Bernoulli sample without replacement."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_report(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """One row: rows, sampled rows and the fraction reached."""
    total = df.agg(F.count(F.lit(1)).alias("n_rows"))
    sampled = sample_rows(df, fraction, seed).agg(F.count(F.lit(1))).scalar()
    return total.withColumn("n_sampled", sampled).withColumn(
        "achieved_fraction", percent(F.col("n_sampled"), F.col("n_rows")) / 100
    )


def sample_ids(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n distinct ids drawn by a seeded hash, the same on every run and layout.

    Only the best n of each partition reach the final selection.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    ids = df.select(key).filter(F.col(key).isNotNull()).distinct()
    return ids.orderBy(digest, key).limit(n)


def sample_series(
    df: DataFrame,
    key: str = "unique_id",
    n: int = 5,
    seed: int = 42,
    columns: Sequence[str] | None = None,
    timestamp: str = "timestamp",
    ids_from: DataFrame | None = None,
) -> DataFrame:
    """Every row of n sampled ids, ordered by id and time.

    The ids come from ``ids_from`` (a dimension) when given, else from the frame itself.  The id list
    is bounded by n, hence broadcast while n is small.
    """
    ids = sample_ids(df if ids_from is None else ids_from, key, n, seed)
    wanted = list(columns or df.columns)
    order = [key] + [timestamp] * (timestamp in wanted)
    ids = F.broadcast(ids) if n <= BROADCAST_ROWS else ids
    return df.join(ids, key, "left_semi").select(*wanted).orderBy(*order)
