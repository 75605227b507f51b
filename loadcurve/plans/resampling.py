"""Resample readings to a fixed step, write them, check the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loadcurve.operators.diagnostics import resample_check
from loadcurve.operators.timeseries import resample
from loadcurve.sources.sinks import read_back, write_table
from loadcurve.sources.tables import read_table


def run_resampling(spark: SparkSession, source: str, target: str, every: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """Returns the written table and its alignment check."""
    hourly = resample(read_table(spark, source, "timestamp"), every=every)
    write_table(hourly, target, inputs=[source])
    written = read_back(spark, target)
    return written, resample_check(written)
