"""Feature vectors, chronological split, regression models and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcurve.functions.scalars import is_missing
from loadcurve.operators.projections import numeric_columns
from loadcurve.session import use_shared_checkpoints

# Rows that a task of boosting passes over.
TASK_ROWS = 500_000


def assemble(
    df: DataFrame, features: Sequence[str] | None = None, target: str = "y", timestamp: str = "timestamp"
) -> DataFrame:
    """(timestamp, features, label); rows with a missing feature are skipped."""
    features = list(features or numeric_columns(df))
    if not features:
        raise ValueError("no numeric feature columns")
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    return assembler.transform(df).select(timestamp, "features", F.col(target).cast("double").alias("label"))


def skipped_rows(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """One row: rows in total, and rows ``assemble`` leaves out for a missing feature."""
    features = list(features or numeric_columns(df))
    missing = F.lit(False)
    for c in features:
        missing = missing | is_missing(df, c)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("n_skipped"))


def split_point(df: DataFrame, timestamp: str = "timestamp", test_ratio: float = 0.2) -> datetime:
    """The instant (UTC) that leaves the last ``test_ratio`` of the time span for testing."""
    span = df.agg(
        F.unix_micros(F.min(timestamp).cast("timestamp")).alias("lo"),
        F.unix_micros(F.max(timestamp).cast("timestamp")).alias("hi"),
    ).first()
    if span["lo"] is None:
        raise ValueError("no timestamps to split on")
    micros = span["lo"] + round((span["hi"] - span["lo"]) * (1 - test_ratio))
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


def split_by_time(df: DataFrame, timestamp: str = "timestamp", test_ratio: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train before the split point, test from it on.

    The split point enters the plan as a literal, so both halves prune at the scan.
    """
    at = F.lit(split_point(df, timestamp, test_ratio))
    return df.filter(F.col(timestamp) < at), df.filter(F.col(timestamp) >= at)


def fit_linear(train: DataFrame) -> LinearRegressionModel:
    return LinearRegression(featuresCol="features", labelCol="label").fit(train)


def _dealt_out(train: DataFrame, task_rows: int) -> DataFrame:
    """More than ``task_rows`` rows in tasks of about that many, so that a task's share does not grow with the table."""
    n = train.count()
    if n <= task_rows:
        return train
    return train.repartition(max(-(-n // task_rows), train.sparkSession.sparkContext.defaultParallelism))


def fit_boosted_trees(
    train: DataFrame, seed: int = 42, max_iter: int = 20, max_depth: int = 5, step_size: float = 0.1, task_rows: int = TASK_ROWS
) -> GBTRegressionModel:
    """Gradient-boosted trees; reliable checkpoints cut the lineage between iterations.

    Every pass reads a task's rows from the cache, some 100 bytes and more each; ``task_rows`` bounds them.
    """
    use_shared_checkpoints(train.sparkSession)
    return GBTRegressor(
        featuresCol="features", labelCol="label", seed=seed, maxIter=max_iter, maxDepth=max_depth, stepSize=step_size
    ).fit(_dealt_out(train, task_rows))


def score(model, df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Append the model's prediction under the given name."""
    scored = model.transform(df)
    return scored if prediction == "prediction" else scored.withColumnRenamed("prediction", prediction)


def evaluate(scored: DataFrame, predictions: Sequence[str] = ("prediction",), label: str = "label") -> DataFrame:
    """(prediction, n, rmse, mae) of each prediction column, all from one pass."""
    long = scored.select(
        F.col(label).alias("__label"), *(F.col(p).cast("double").alias(p) for p in predictions)
    ).unpivot(["__label"], list(predictions), "prediction", "value")
    error = F.col("value") - F.col("__label")
    return long.groupBy("prediction").agg(
        F.count(error).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae")
    )


def feature_importance(model: GBTRegressionModel, features: Sequence[str], df: DataFrame, top: int = 10) -> DataFrame:
    """The most important features of a tree model, descending (one row per feature column exists)."""
    weights = [float(w) for w in model.featureImportances.toArray()]
    if len(weights) != len(features):
        raise ValueError("feature names do not match the model")
    table = df.sparkSession.createDataFrame(list(zip(features, weights)), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_linear(path: str) -> LinearRegressionModel:
    return LinearRegressionModel.load(path)


def load_boosted_trees(path: str) -> GBTRegressionModel:
    return GBTRegressionModel.load(path)
