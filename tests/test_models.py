import random

import pytest
from pyspark.sql import functions as F

from conftest import READING, at
from loadcurve.operators import regression
from loadcurve.plans import completeness, features, merge, profiling, resampling, training
from loadcurve.session import scratch_path, use_shared_checkpoints


@pytest.fixture()
def linear(frame):
    rng = random.Random(0)
    rows = []
    for i in range(400):
        a, b = rng.uniform(0, 10), rng.uniform(0, 10)
        rows.append(("s", at(i), a, b, 2 * a - b + rng.gauss(0, 0.01)))
    return frame(rows, "unique_id string, timestamp timestamp, x1 double, x2 double, y double")


def test_split_by_time_partitions_the_rows(linear):
    train, test = regression.split_by_time(linear)
    assert train.count() + test.count() == 400
    assert train.agg(F.max("timestamp")).first()[0] < test.agg(F.min("timestamp")).first()[0]
    assert test.count() == 80
    with pytest.raises(ValueError):
        regression.split_by_time(linear.limit(0))


def test_skipped_rows_are_counted(frame):
    df = frame([(at(0), 1.0, 2.0), (at(1), None, 2.0), (at(2), float("nan"), 1.0)], "timestamp timestamp, x double, y double")
    assert tuple(regression.skipped_rows(df, ["x"]).first()) == (3, 2)
    assert regression.assemble(df, ["x"]).count() == 1
    with pytest.raises(ValueError):
        regression.assemble(df.select("timestamp", "y"))


def test_linear_model_recovers_coefficients_and_survives_saving(linear, spark):
    train, test = regression.split_by_time(regression.assemble(linear))
    model = regression.fit_linear(train)
    assert list(model.coefficients) == pytest.approx([2.0, -1.0], abs=0.01)
    path = scratch_path(spark, "model")
    regression.save_model(model, path)
    regression.save_model(model, path)
    again = regression.load_linear(path)
    both = regression.score(again, regression.score(model, test, "first"))
    assert both.filter("abs(first - prediction) > 1e-12").count() == 0


def test_training_beats_the_mean_predictor(linear, spark):
    path = scratch_path(spark, "models")
    trained = training.train_and_evaluate(linear, max_iter=5, models_path=path)
    metrics = {r.prediction: r for r in trained.metrics.collect()}
    spread = linear.agg(F.stddev("y")).first()[0]
    assert metrics["linear"].rmse < 0.05 and metrics["boosted"].rmse < spread
    assert metrics["linear"].n == 80 and metrics["linear"].mae <= metrics["linear"].rmse
    importance = trained.importance.collect()
    assert [r.feature for r in importance] == ["x1", "x2"]
    assert sum(r.importance for r in importance) == pytest.approx(1.0)
    loaded = regression.load_boosted_trees(f"{path}/boosted_trees")
    assert loaded.featureImportances == trained.boosted.featureImportances
    with pytest.raises(ValueError):
        regression.feature_importance(trained.boosted, ["x1"], linear)


def test_boosting_deals_its_rows_into_bounded_tasks(frame):
    rows = [("s", at(i), float(i % 7), 1.0, 100.0 if i % 7 > 3 else -100.0) for i in range(2000)]
    train = regression.assemble(frame(rows, "unique_id string, timestamp timestamp, x double, noise double, y double").coalesce(1), ["x", "noise"])
    dealt = regression._dealt_out(train, 100)
    per_task = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) == 20 and sum(per_task) == 2000 and max(per_task) <= 110
    assert regression._dealt_out(train, 2000) is train
    whole, parts = regression.fit_boosted_trees(train, max_iter=3), regression.fit_boosted_trees(train, max_iter=3, task_rows=100)
    assert whole.featureImportances == parts.featureImportances
    both = regression.score(whole, regression.score(parts, train, "parts"), "whole")
    assert both.filter("abs(parts - whole) > 1e-9").count() == 0


@pytest.mark.parametrize("query", ["x10_importance_of_step_target", "x11_saved_trees_score_alike"])
def test_boosting_queries_fit_bounded_tasks(spark, monkeypatch, query):
    from checks import ALL_QUERIES

    class Reached(Exception):
        pass

    def stop(_, rows):
        raise Reached([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()])

    # 1.2 million rows that one task scans
    folder = scratch_path(spark, "tables")
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    lines.union(lines).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    monkeypatch.setattr(regression.GBTRegressor, "fit", stop)
    with pytest.raises(Reached) as reached:
        ALL_QUERIES[query](spark, folder)
    per_task = reached.value.args[0]
    assert 900_000 < sum(per_task) <= 1_200_000 and max(per_task) <= 500_000


def test_metrics_query_joins_its_tables_once(spark, monkeypatch):
    from checks import ALL_QUERIES

    class Reached(Exception):
        pass

    def stop(merged, **_):
        raise Reached(merged.inputFiles())

    monkeypatch.setattr(features, "build_features", stop)
    with pytest.raises(Reached) as reached:
        ALL_QUERIES["q3_model_metrics"](spark, "/root/testdata/sf0.001")
    read = reached.value.args[0]
    assert read and all("/merged-" in path for path in read)


def test_checkpoints_use_the_shared_folder(spark):
    use_shared_checkpoints(spark)
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()


@pytest.fixture()
def inputs(frame, spark):
    demand = frame([(k, at(h / 4), float(h % 9)) for k in ("a", "b", "c") for h in range(120)] + [("a", at(99), None)], READING)
    metadata = frame(
        [("a", "L", "res", 1.0, "X"), ("b", "M", "com", 2.0, "Y"), ("c", None, None, 3.0, "Y")],
        "unique_id string, location_id string, building_class string, cluster_size double, dataset string",
    )
    weather = frame(
        [("L", at(h), 1.0 * h, 2.0 * (h % 5)) for h in range(30)] + [("L", at(0), 50.0, 0.0)],
        "location_id string, timestamp timestamp, temperature_2m double, rain double",
    )
    paths = [scratch_path(spark, n) for n in ("d", "m", "w")]
    for df, path in zip((demand, metadata, weather), paths):
        df.write.parquet(path)
    return demand, metadata, weather, paths


def test_file_to_file_plans(inputs, spark):
    demand, metadata, weather, (d, m, w) = inputs
    reports = merge.run_merge(spark, d, m, w, scratch_path(spark, "merged"), weather_order=["temperature_2m"])
    merged = reports["merged"]
    assert merged.count() == demand.count()
    assert merged.columns == [
        "unique_id", "timestamp", "y", "location_id", "building_class", "cluster_size", "temperature_2m", "rain",
    ]
    assert tuple(reports["coverage"].first())[:4] == (3, 1, 1, 2)
    assert {r.location_id: r.issues for r in reports["ranges"].collect()} == {"L": "ends late", "M": "no weather", None: "null key"}
    assert reports["success"].first().n_located_unmatched == 121

    source = merged.inputFiles()[0].rsplit("/", 1)[0]
    built = features.run_features(spark, source, scratch_path(spark, "features"), windows=(3, 6))
    assert built.count() == 360 and "y_rolling_max_6h" in built.columns and "dayofyear" in built.columns
    full = features.build_features(merged, windows=(3, 6), initial_window="full")
    assert full.count() == 360 - 3 * 5 and not [c for c in full.columns if "_rows_" in c]
    assert features.build_features(merged, windows=(3,), sample_fraction=0.5).count() < 360

    audit = completeness.audit_weather(weather, merged, exclude=["None"])
    assert audit["overall"].first().completeness_pct == 100.0
    # location M has no weather at all, L none at the hour of its null reading
    assert audit["unmatched"].count() == 30 + 1 and audit["unmatched"].filter("in_weather").count() == 0

    hourly, check = resampling.run_resampling(spark, d, scratch_path(spark, "hourly"))
    assert hourly.count() == 91 and check.first().aligned


def test_merge_refuses_to_replace_an_input(inputs, spark):
    _, _, _, (d, m, w) = inputs
    with pytest.raises(ValueError, match="refusing"):
        merge.run_merge(spark, d, m, w, d)


def test_profile_of_all_tables(inputs):
    demand, metadata, weather, _ = inputs
    report = profiling.profile_tables(demand, metadata, weather)
    assert set(report) == {"demand", "metadata", "weather", "relations", "quality"}
    assert report["demand"]["counts"].first().n_null == 1
    assert report["relations"]["by_dataset"].count() == 2
    assert report["metadata"]["missing_location"].count() == 2
    assert report["quality"]["tables"].count() == 3
    for group in report.values():
        for frame in group.values():
            assert frame.limit(1).count() <= 1
