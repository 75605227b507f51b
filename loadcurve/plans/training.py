"""Train and evaluate the two regressors on a chronological split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
from pyspark.sql import DataFrame

from loadcurve.operators.projections import numeric_columns
from loadcurve.operators.regression import (
    assemble, evaluate, feature_importance, fit_boosted_trees, fit_linear, save_model, score, skipped_rows, split_by_time,
)
from loadcurve.session import stored


@dataclass(frozen=True)
class Trained:
    linear: LinearRegressionModel
    boosted: GBTRegressionModel
    features: list[str]
    scored: DataFrame
    metrics: DataFrame
    importance: DataFrame
    skipped: DataFrame  # rows in total, and rows left out for a missing feature


def train_and_evaluate(
    features: DataFrame,
    columns: Sequence[str] | None = None,
    target: str = "y",
    test_ratio: float = 0.2,
    models_path: str | None = None,
    **boosting,
) -> Trained:
    """Both models on the same training rows; the test rows are scored and measured in one pass.

    Training reads its rows several times, so they are stored assembled, once.
    """
    columns = list(columns or numeric_columns(features))
    train, test = split_by_time(assemble(features, columns, target), test_ratio=test_ratio)
    train = stored(train)
    linear = fit_linear(train)
    boosted = fit_boosted_trees(train, **boosting)
    if models_path:
        save_model(linear, f"{models_path}/linear_regression")
        save_model(boosted, f"{models_path}/boosted_trees")
    scored = score(boosted, score(linear, test, "linear"), "boosted")
    return Trained(
        linear, boosted, columns, scored, evaluate(scored, ["linear", "boosted"]),
        feature_importance(boosted, columns, features), skipped_rows(features, columns),
    )
