import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import READING, at
from loadcurve.functions import times
from loadcurve.sources import sinks, tables


def test_text_timestamps_become_null_when_unparsable(frame):
    df = frame([("2024-01-01 00:00:00",), ("not a time",), (None,)], "timestamp string")
    assert [r[0] for r in times.as_timestamp(df).collect()] == [datetime(2024, 1, 1), None, None]
    assert times.drop_unparsed(df).count() == 1
    assert times.parse_report(df).first().asDict() == {"n_rows": 3, "n_kept": 1, "n_dropped": 2}


def test_zone_free_timestamps_are_converted(frame):
    df = frame([(at(1),)], "timestamp timestamp_ntz")
    assert times.as_timestamp(df).schema["timestamp"].dataType.simpleString() == "timestamp"


def test_other_types_are_refused(frame):
    with pytest.raises(TypeError):
        times.as_timestamp(frame([(1.5,)], "timestamp double"))


def test_contract_names_each_problem(frame):
    df = frame([("a", 1.0)], "unique_id string, timestamp double")
    assert tables.contract_problems(df, tables.DEMAND) == ["column timestamp has type double", "missing column y"]
    with pytest.raises(ValueError, match="missing column y"):
        tables.check_contract(df, tables.DEMAND)
    empty = frame([], READING)
    assert tables.contract_problems(empty, tables.DEMAND, require_rows=True) == ["no rows"]


def test_load_tables_checks_and_normalises(frame, spark, tmp_path):
    d, m, w = (str(tmp_path / n) for n in "dmw")
    frame([("a", "2024-01-01 00:00:00", 1.0)], "unique_id string, timestamp string, y double").write.parquet(d)
    frame([("a", "L")], "unique_id string, location_id string").write.parquet(m)
    frame([("L", at(0))], "location_id string, timestamp timestamp_ntz").write.parquet(w)
    demand, _, weather = tables.load_tables(spark, d, m, w)
    assert demand.first()["timestamp"] == at(0)
    assert weather.schema["timestamp"].dataType.simpleString() == "timestamp"


def test_sink_refuses_its_own_input(frame, spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(frame([("a", at(0), 1.0)], READING), path)
    with pytest.raises(ValueError, match="refusing"):
        sinks.write_table(spark.read.parquet(path), path)
    with pytest.raises(ValueError, match="refusing"):
        sinks.write_table(spark.read.parquet(path), path, inputs=[path])
    assert sinks.written_rows(spark, path) == 1


def test_partitioned_round_trip_keeps_rows_and_prunes(frame, spark, tmp_path):
    rows = [(f"s{i % 7}", at(24 * i), float(i)) for i in range(400)]
    dated = times.calendar_features(frame(rows, READING))
    path = str(tmp_path / "t")
    sinks.write_partitioned(dated, path, sort_by=("unique_id", "timestamp"))
    back = sinks.read_back(spark, path)
    assert back.count() == 400
    assert back.agg(F.sum("y")).first()[0] == sum(range(400))
    assert dict(back.dtypes)["year"] == "int"
    plan = back.filter("year = 2024 and month = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_one_file_per_folder_for_small_data(frame, spark, tmp_path):
    dated = times.calendar_features(frame([("a", at(24 * i), 1.0) for i in range(60)], READING).repartition(16))
    path = tmp_path / "t"
    sinks.write_partitioned(dated, str(path))
    assert len(list(path.glob("year=*/month=*/*.parquet"))) == 2


def test_millisecond_rewrite_refuses_to_lose_precision(frame, spark, tmp_path):
    fine, coarse, out = (str(tmp_path / n) for n in ("fine", "coarse", "out"))
    frame([(datetime(2024, 1, 1, 0, 0, 0, 1),)], "timestamp timestamp").write.parquet(fine)
    frame([(datetime(2024, 1, 1, 0, 0, 0, 5000),)], "timestamp timestamp").write.parquet(coarse)
    with pytest.raises(sinks.PrecisionLossError):
        sinks.rewrite_with_millisecond_timestamps(spark, fine, out)
    before = spark.conf.get("spark.sql.parquet.outputTimestampType")
    sinks.rewrite_with_millisecond_timestamps(spark, coarse, out)
    assert spark.conf.get("spark.sql.parquet.outputTimestampType") == before
    assert spark.read.parquet(out).first()[0] == datetime(2024, 1, 1, 0, 0, 0, 5000)


def test_table_profile(frame):
    df = frame([("a", at(0), 1.0), ("b", at(0), None)], READING)
    assert [tuple(r) for r in tables.table_profile({"t": df, "e": df.limit(0)}).collect()] == [("t", 2, 3), ("e", 0, 3)]
    spread = tables.table_profile({"t": df.repartition(2).limit(1)}, partitions=True).first()
    assert (spread.n_rows, spread.n_partitions) == (1, 1)
    assert tables.preview(df, 1).count() == 1


def test_every_timestamp_column_is_checked_before_a_rewrite(spark, frame, tmp_path):
    rows = [(at(0), datetime(2024, 1, 1, 0, 0, 0, 123456)), (at(1), None)]
    frame(rows, "timestamp timestamp, seen timestamp").write.parquet(f"{tmp_path}/in")
    with pytest.raises(sinks.PrecisionLossError):
        sinks.rewrite_with_millisecond_timestamps(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert not (tmp_path / "out").exists()


def test_overwrite_guard_follows_relative_paths_and_links(spark, frame, tmp_path, monkeypatch):
    frame([(1,)], "a int").write.parquet(f"{tmp_path}/in")
    (tmp_path / "link").symlink_to(tmp_path / "in")
    relative = os.path.relpath(tmp_path / "in", os.getcwd())
    for target in (relative, f"{tmp_path}/link", f"file://{tmp_path}/in/", str(tmp_path)):
        with pytest.raises(ValueError):
            sinks.write_table(spark.read.parquet(f"{tmp_path}/in"), target)
        with pytest.raises(ValueError):
            sinks.write_table(spark.read.parquet(f"{tmp_path}/in"), target, inputs=[f"{tmp_path}/in"])
    assert spark.read.parquet(f"{tmp_path}/in").count() == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def readings(frame):
    return frame([(k, at(24 * d + h), float(d)) for k in ("a", "b", "c") for d in range(0, 90, 3) for h in (0, 5)], READING)


def test_time_ranges_read_only_their_folders(spark, readings, tmp_path):
    path = f"{tmp_path}/months"
    dated = readings.select("*", F.year("timestamp").alias("year"), F.month("timestamp").alias("month"))
    sinks.write_partitioned(dated, path)
    for start, end in ((at(24 * 40), at(24 * 50)), (None, at(24 * 31)), (at(24 * 31), None), (at(24 * 20), at(24 * 20)), (None, None)):
        got = sinks.read_time_range(spark, path, start, end)
        want = readings.filter(F.col("timestamp") >= start if start else F.lit(True)).filter(F.col("timestamp") < end if end else F.lit(True))
        assert sorted(map(str, got.select(readings.columns).collect())) == sorted(map(str, want.collect()))
    february = sinks.read_time_range(spark, path, at(24 * 40), at(24 * 50))
    filters = plan(february).split("PartitionFilters: [")[1].split("], PushedFilters")[0]
    assert "year" in filters and "month" in filters
    assert [r.month for r in february.select("month").distinct().collect()] == [2]


def test_tables_by_series_need_no_shuffle(spark, readings, tmp_path):
    from loadcurve.operators.rolling import rolling_features
    from loadcurve.operators.timeseries import intervals

    table = sinks.write_by_series(readings, f"{tmp_path}/series", "readings_by_series", buckets=4)
    assert sorted(map(str, table.collect())) == sorted(map(str, readings.collect()))
    for windowed in (rolling_features(table, windows=(3, 6)), intervals(table)):
        assert "Exchange" not in plan(windowed)
    assert "Exchange" in plan(rolling_features(readings, windows=(3, 6)))
    options = dict(windows=(3, 6), stats=["mean", "max"])
    assert sorted(map(str, rolling_features(table, **options).collect())) == sorted(map(str, rolling_features(readings, **options).collect()))
    with pytest.raises(ValueError):
        sinks.write_by_series(table, f"{tmp_path}/series", "readings_by_series", buckets=4)


def test_metrics_are_observed_while_writing(spark, readings, tmp_path):
    seen = sinks.write_table(readings, f"{tmp_path}/observed", observe=[F.count(F.lit(1)).alias("n"), F.max("y").alias("top")])
    assert seen == {"n": readings.count(), "top": 87.0}
    assert sinks.write_table(readings, f"{tmp_path}/observed") == {}


def test_merge_counts_success_while_writing(spark, frame, tmp_path):
    from loadcurve.operators.diagnostics import join_success
    from loadcurve.plans.merge import run_merge

    demand = frame([(k, at(h), 1.0) for k in ("a", "b", "x") for h in range(4)], READING)
    metadata = frame([("a", "L", "c", 1.0), ("b", "M", "c", 2.0)], "unique_id string, location_id string, building_class string, cluster_size double")
    weather = frame([("L", at(h), 10.0 + h) for h in range(3)], "location_id string, timestamp timestamp, temperature_2m double")
    paths = {n: f"{tmp_path}/{n}" for n in ("demand", "metadata", "weather")}
    for name, df in (("demand", demand), ("metadata", metadata), ("weather", weather)):
        df.write.parquet(paths[name])
    reports = run_merge(spark, paths["demand"], paths["metadata"], paths["weather"], f"{tmp_path}/merged")
    assert "FileScan" not in plan(reports["success"])
    assert reports["success"].first() == join_success(reports["merged"]).first()
    assert (reports["success"].first().n_rows, reports["success"].first().n_located_unmatched) == (12, 5)
