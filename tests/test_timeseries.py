import pytest
from pyspark.sql import functions as F

from conftest import READING, at
from loadcurve.functions import scalars, times
from loadcurve.operators import diagnostics, timeseries


@pytest.fixture()
def mixed(frame):
    """a every 15, b every 30, c every 60 minutes, two hours each."""
    steps = {"a": 0.25, "b": 0.5, "c": 1.0}
    return frame([(k, at(i * s), float(i)) for k, s in steps.items() for i in range(int(2 / s))], READING)


def test_resample_preserves_the_sum(mixed):
    hourly = timeseries.resample(mixed)
    assert hourly.count() == 6
    assert hourly.agg(F.sum("y")).first()[0] == mixed.agg(F.sum("y")).first()[0]
    assert diagnostics.resample_check(hourly).first()["aligned"]
    assert {(r.unique_id, r.timestamp): r.y for r in hourly.collect()}["a", at(1)] == 4 + 5 + 6 + 7


def test_resample_sum_of_nothing_is_null_and_bad_stamps_drop(frame):
    df = frame([("a", "2024-01-01 00:10:00", None), ("a", "bad", 3.0)], "unique_id string, timestamp string, y double")
    assert [tuple(r) for r in timeseries.resample(df).collect()] == [("a", at(0), None)]


def test_resample_needs_its_columns(frame):
    with pytest.raises(ValueError, match="missing columns"):
        timeseries.resample(frame([("a",)], "unique_id string"))


def test_intervals_and_their_mode(mixed):
    gaps = timeseries.intervals(mixed)
    assert {tuple(r) for r in timeseries.interval_counts(gaps).collect()} == {(900, 7), (1800, 3), (3600, 1)}
    assert timeseries.dominant_interval(gaps, 900).first().asDict() == {"diff_seconds": 900, "is_expected": True}
    assert not any(r.multiple for r in timeseries.multiple_intervals(gaps).collect())


def test_series_with_two_intervals_is_flagged(frame):
    gaps = timeseries.intervals(frame([("a", at(h), 1.0) for h in (0, 1, 3)] + [("b", at(0), 1.0)], READING))
    assert [tuple(r) for r in timeseries.multiple_intervals(gaps).collect()] == [("a", 2, True)]


@pytest.mark.parametrize("max_rows", [1, 2, 7, 40])
def test_intervals_of_split_series_equal_whole_ones(frame, max_rows):
    rows = [("hot", at(i * i / 50), 1.0) for i in range(120)] + [("cold", at(i), 1.0) for i in range(3)] + [(None, at(5), 1.0)]
    df = frame(rows, READING)
    whole = sorted(map(str, timeseries.intervals(df).collect()))
    split = sorted(map(str, timeseries.intervals(df, max_series_rows=max_rows).collect()))
    assert split == whole and len(whole) == 119 + 2


def test_completeness_of_a_series_with_a_hole(frame):
    rows = [("L", at(h)) for h in range(24) if not 5 <= h < 10]
    found = timeseries.completeness(frame(rows, "location_id string, timestamp timestamp")).first()
    assert (found.actual_records, found.expected_records) == (19, 24)
    assert found.completeness_pct == pytest.approx(100 * 19 / 24)


def test_overall_completeness_sums_locations(frame):
    rows = [("L", at(0)), ("L", at(3)), ("M", at(0))]
    per_key = timeseries.completeness(frame(rows, "location_id string, timestamp timestamp"))
    assert tuple(timeseries.overall_completeness(per_key).first()) == (3, 5, 60.0)


def test_deduplication_is_determined_by_the_order(frame):
    rows = [("L", at(0), 2.0, 9), ("L", at(0), 1.0, 3), ("M", at(0), 5.0, 1)]
    df = frame(rows, "location_id string, timestamp timestamp, t double, seq int")
    kept = timeseries.deduplicate_ordered(df, ["location_id", "timestamp"], ["seq"]).collect()
    assert sorted((r.location_id, r.t) for r in kept) == [("L", 1.0), ("M", 5.0)]
    assert timeseries.deduplicate(df, ["location_id", "timestamp"]).count() == 2


def test_distinct_keys_count_null_once(frame):
    df = frame([("a",), (None,), (None,)], "k string")
    assert timeseries.key_count(df, "k").first()[0] == 2


def test_averages_in_one_pass_agree_with_separate_ones(frame):
    df = frame([("a", at(7 * h), float(h)) for h in range(300)], READING)
    one = {(r.part, r.position): r.avg_demand for r in timeseries.average_by_all_parts(df).collect()}
    for part in ("hour", "dayofweek", "month"):
        for row in timeseries.average_by(df, part).collect():
            assert one[part, row[part]] == pytest.approx(row.avg_demand)


def test_calendar_labels(frame):
    row = (
        times.calendar_features(frame([(at(0),)], "timestamp timestamp"))
        .select("*", times.weekday_name("dayofweek").alias("day_name"), times.month_name("month").alias("month_name"))
        .first()
    )
    assert (row.year, row.month, row.day, row.dayofweek, row.dayofyear, row.hour) == (2024, 1, 1, 2, 1, 0)
    assert (row.day_name, row.month_name) == ("Mon", "Jan")


def test_scalar_guards(frame):
    nan, inf = float("nan"), float("inf")
    df = frame([(None,), (nan,), (-1.0,), (0.0,), (1.0,), (inf,)], "y double")
    rows = df.select(
        scalars.is_missing(df, "y").alias("missing"),
        scalars.finite_or_null(F.col("y")).alias("finite"),
        scalars.log1p_shifted(F.col("y")).isNotNull().alias("logged"),
        scalars.percent(F.lit(1), F.col("y")).alias("pct"),
    ).collect()
    assert [r.missing for r in rows] == [True, True, False, False, False, False]
    assert [r.finite for r in rows] == [None, None, -1.0, 0.0, 1.0, None]
    assert [r.logged for r in rows] == [False, False, False, True, True, True]
    assert rows[3].pct is None and rows[4].pct == 100.0
    text = frame([("7",), ("x",), (None,)], "v string").select(
        scalars.to_number(F.col("v")).alias("n"), scalars.label_or(F.col("v"), "?").alias("l")
    )
    assert [tuple(r) for r in text.collect()] == [(7.0, "7"), (None, "x"), (None, "?")]
    shown = frame([(5400,)], "s int").select(scalars.as_interval(F.col("s")).cast("string").alias("i")).first()[0]
    assert shown == "INTERVAL '0 01:30:00' DAY TO SECOND"


def test_first_row_per_key_without_sort(spark, frame):
    rows = [("a", 3, 1.0), ("a", 1, None), ("a", 2, 5.0), ("b", None, 7.0), ("b", 0, 8.0), (None, 5, 1.0), (None, 4, 2.0), ("c", None, None)]
    df = frame(rows, "k string, n int, v double").repartition(4)
    first = timeseries.deduplicate_ordered(df, ["k"], ["n"])
    assert {tuple(r) for r in first.collect()} == {("a", 1, None), ("b", None, 7.0), (None, 4, 2.0), ("c", None, None)}
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Sort" not in plan and "Window" not in plan
    # an order of several columns, or values of any width, keep the window
    assert "Window" in timeseries.deduplicate_ordered(df, ["k"], ["n", "v"])._jdf.queryExecution().executedPlan().toString()
    wide = timeseries.deduplicate_ordered(df.withColumn("s", F.lit("s")), ["k"], ["n"])
    assert {r.k: r.n for r in wide.collect()} == {"a": 1, "b": None, None: 4, "c": None}
