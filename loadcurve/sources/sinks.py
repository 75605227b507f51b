"""Parquet sinks that never overwrite what they read."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.functions.times import as_timestamp


class PrecisionLossError(ValueError):
    """Raised when coarser timestamps would drop information."""


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, made absolute; links of local paths are followed."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    uri = system.makeQualified(hadoop_path).toUri()
    if uri.getScheme() == "file":
        return "file:" + os.path.realpath(uri.getPath())
    return uri.toString().rstrip("/")


def _refuse_input_path(df: DataFrame, path: str, inputs: Iterable[str] | None) -> None:
    """Stop a write that would delete files the plan still has to read.

    Callers that know their input roots pass them; otherwise the plan's file list is used.
    """
    spark = df.sparkSession
    target = _qualified(spark, path)
    for source in {p.rsplit("/", 1)[0] for p in df.inputFiles()} if inputs is None else inputs:
        source = _qualified(spark, source)
        if source == target or source.startswith(target + "/") or target.startswith(source + "/"):
            raise ValueError(f"refusing to overwrite an input of the plan: {path}")


def write_table(df: DataFrame, path: str, inputs: Iterable[str] | None = None, observe: Sequence[Column] = ()) -> dict:
    """Overwrite ``path`` with the frame; returns the values of the ``observe`` aggregates over the rows written.

    They are gathered by the tasks that write, so nothing is read again.
    """
    _refuse_input_path(df, path, inputs)
    if not observe:
        df.write.mode("overwrite").parquet(path)
        return {}
    seen = Observation()
    df.observe(seen, *observe).write.mode("overwrite").parquet(path)
    return seen.get


def write_partitioned(
    df: DataFrame,
    path: str,
    by: tuple[str, ...] = ("year", "month"),
    sort_by: tuple[str, ...] = (),
    inputs: Iterable[str] | None = None,
) -> None:
    """Overwrite ``path``, laid out in folders by the given columns.

    The rebalance hint groups rows by folder and lets adaptive execution cut a folder that holds
    much of the data into several tasks and pool small ones, so neither one huge month nor many
    tiny files result.
    """
    _refuse_input_path(df, path, inputs)
    laid_out = df.hint("rebalance", *by)
    if sort_by:
        laid_out = laid_out.sortWithinPartitions(*by, *sort_by)
    laid_out.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_by_series(
    df: DataFrame, path: str, table: str, key: str = "unique_id", timestamp: str = "timestamp", buckets: int = 200,
    inputs: Iterable[str] | None = None,
) -> DataFrame:
    """Write a catalog table at ``path`` in one file per bucket of series, sorted by series and time, and return it.

    Windows over a series and joins or groupings on ``key`` then start without a shuffle.  Choose ``buckets`` so that
    one of them, the share of ``1 / buckets`` of the series, fits a task.
    """
    _refuse_input_path(df, path, inputs)
    laid_out = df.repartition(buckets, key)
    writer = laid_out.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key, timestamp)
    writer.format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def read_time_range(
    spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None, timestamp: str = "timestamp"
) -> DataFrame:
    """Rows from ``start`` on and before ``end`` of a table in year and month folders; only folders of that time are listed.

    Datetimes without zone are read in the session's zone, as the folders' years and months are.
    """
    df, zone = read_back(spark, path), ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))
    month = F.col("year") * 12 + F.col("month")
    years = F.col("year")
    for bound, is_start in ((start, True), (end, False)):
        if bound is None:
            continue
        local = bound.replace(tzinfo=zone) if bound.tzinfo is None else bound.astimezone(zone)
        at, number = F.lit(local), F.lit(local.year * 12 + local.month)
        stamp = F.col(f"`{timestamp}`")
        # a bound on whole folders first: comparisons of partition columns prune the listing
        df = df.filter(years >= local.year).filter(month >= number) if is_start else df.filter(years <= local.year).filter(month <= number)
        df = df.filter(stamp >= at) if is_start else df.filter(stamp < at)
    return df


def read_back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def written_rows(spark: SparkSession, path: str) -> int:
    """Rows found when reading a written table again (answered from Parquet footers)."""
    return read_back(spark, path).count()


def timestamp_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]


def sub_millisecond_rows(df: DataFrame, columns: str | Sequence[str] = "timestamp") -> int:
    """Rows in which one of the timestamps is finer than a millisecond, counted in one pass."""
    finer = F.lit(False)
    for name in [columns] if isinstance(columns, str) else columns:
        df = as_timestamp(df, name)
        ts = F.col(f"`{name}`")
        finer = finer | F.coalesce(ts != F.date_trunc("millisecond", ts), F.lit(False))
    return df.filter(finer).count()


def rewrite_with_millisecond_timestamps(spark: SparkSession, source: str, target: str, column: str = "timestamp") -> None:
    """Copy a Parquet table with timestamps stored in milliseconds.

    The setting applies to every timestamp column, so all of them are checked; raises before writing
    anything if one would lose precision.
    """
    df = as_timestamp(spark.read.parquet(source), column)
    lossy = sub_millisecond_rows(df, timestamp_columns(df))
    if lossy:
        raise PrecisionLossError(f"{lossy} rows in {source} are finer than a millisecond")
    key = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(key)
    spark.conf.set(key, "TIMESTAMP_MILLIS")
    try:
        write_table(df, target, inputs=[source])
    finally:
        spark.conf.set(key, before)
