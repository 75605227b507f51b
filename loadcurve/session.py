"""Small helpers around a session that the caller created."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def pin_utc(spark: SparkSession) -> SparkSession:
    """Make zoned and zone-free timestamps print and compare the same everywhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``.  A machine-local folder is used only
    where that setting is absent, which is the case in local-mode tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{tempfile.gettempdir()}/loadcurve-shared"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Point reliable checkpoints (used by iterative MLlib fits) at the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def stored(df: DataFrame) -> DataFrame:
    """Compute a small intermediate once and read it from the shared folder from then on."""
    use_shared_checkpoints(df.sparkSession)
    return df.checkpoint()
