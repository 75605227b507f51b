import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import READING, at
from loadcurve.operators import filters, rolling, skew, time_frames, timeseries

STATS = ["mean", "stddev", "min", "max"]


@pytest.mark.parametrize("windows", [(3, 6, 12, 24, 48, 168), (3, 6, 12, 24, 168), (168,), (2, 5, 7, 11), (1,), (1, 1000)])
def test_composition_covers_every_frame_exactly_once(windows):
    known = {1}
    for stage in rolling.composition(windows):
        for size, parts in stage.items():
            covered = [row for part, offset in parts for row in range(offset, offset + part)]
            assert sorted(covered) == list(range(size))
            assert {part for part, _ in parts} <= known
        known |= set(stage)
    assert set(windows) <= known


def series(seed: int):
    rng = random.Random(seed)
    rows = []
    for key, n in (("hot", 260), ("warm", 40), ("single", 1), (None, 15)):
        hour = 0.0
        for i in range(n):
            hour += rng.choice([0.25, 0.5, 1, 1, 1, 6])
            y = rng.choice([None, 0.0, 5.0, rng.uniform(-50, 1000), rng.uniform(0, 1)])
            rows.append((key, at(hour), y))
    return rows


def same(left, right, on=("unique_id", "timestamp")):
    a = {tuple(r[c] for c in on): r.asDict() for r in left.collect()}
    b = {tuple(r[c] for c in on): r.asDict() for r in right.collect()}
    assert a.keys() == b.keys()
    for key, row in a.items():
        for name, value in row.items():
            other = b[key][name]
            if isinstance(value, float) and value == value:
                assert other == pytest.approx(value, rel=1e-9, abs=1e-9), (key, name)
            else:
                assert other == value, (key, name)


def direct(df, windows, include_current=True):
    order = Window.partitionBy("unique_id").orderBy("timestamp")
    last = 0 if include_current else -1
    frames = {n: order.rowsBetween(last - n + 1, last) for n in windows}
    return rolling._direct_frames(df, frames, "y", [*STATS, "rows"])


@pytest.mark.parametrize("windows", [(3, 6, 12, 24, 48, 168), (1, 7, 100)])
@pytest.mark.parametrize("include_current", [True, False])
def test_composed_frames_equal_direct_ones(frame, windows, include_current):
    df = frame(series(1), READING)
    composed = rolling.rolling_features(df, windows=windows, stats=[*STATS, "rows"], include_current=include_current)
    same(composed, direct(df, windows, include_current))


@pytest.mark.parametrize("max_rows", [1, 10, 60])
@pytest.mark.parametrize("include_current", [True, False])
def test_split_series_give_the_same_features(frame, max_rows, include_current):
    df = frame(series(2), READING)
    options = dict(windows=(3, 24, 48), stats=[*STATS, "rows"], include_current=include_current)
    same(rolling.rolling_features(df, max_series_rows=max_rows, **options), rolling.rolling_features(df, **options))


@pytest.mark.parametrize("include_current", [True, False])
def test_split_series_give_the_same_hour_ranges(frame, include_current):
    df = frame(series(3), READING)
    options = dict(windows=(3, 24), frame="range", include_current=include_current)
    same(rolling.rolling_features(df, max_series_rows=20, **options), rolling.rolling_features(df, **options))


def test_bursts_larger_than_a_chunk_stay_correct(frame):
    # 90 records within one hour, chunks of 10
    rows = [("a", at(i / 90), float(i % 13)) for i in range(90)] + [("a", at(2 + i), float(i)) for i in range(30)]
    df = frame(rows, READING)
    options = dict(windows=(3, 48), stats=STATS)
    same(rolling.rolling_features(df, max_series_rows=10, **options), rolling.rolling_features(df, **options))


def test_rows_and_hours_differ_across_a_gap(frame):
    df = frame([("a", at(h), float(h)) for h in (0, 1, 2, 8, 9)], READING)
    rows = {r.timestamp: r for r in rolling.rolling_features(df, windows=[3]).collect()}
    hours = {r.timestamp: r for r in rolling.rolling_features(df, windows=[3], frame="range").collect()}
    assert rows[at(8)].y_rolling_mean_3h == pytest.approx((1 + 2 + 8) / 3)
    assert hours[at(8)].y_rolling_mean_3h == 8.0
    assert hours[at(2)].y_rolling_mean_3h == rows[at(2)].y_rolling_mean_3h == 1.0


def test_single_record_has_no_deviation(frame):
    row = rolling.rolling_features(frame([("a", at(0), 2.0)], READING), windows=[3]).first()
    assert (row.y_rolling_mean_3h, row.y_rolling_stddev_3h, row.y_rolling_min_3h) == (2.0, None, 2.0)


def test_mean_lies_between_extremes(frame):
    df = rolling.rolling_features(frame(series(4), READING), windows=[6])
    assert df.filter("y_rolling_min_6h > y_rolling_mean_6h + 1e-9 or y_rolling_mean_6h > y_rolling_max_6h + 1e-9").count() == 0


def test_nan_spreads_like_in_sql_aggregates(frame):
    df = frame([("a", at(h), y) for h, y in enumerate([1.0, float("nan"), 3.0, 4.0, 5.0])], READING)
    row = {r.timestamp: r for r in rolling.rolling_features(df, windows=[3]).collect()}
    assert math.isnan(row[at(2)].y_rolling_mean_3h) and math.isnan(row[at(2)].y_rolling_max_3h)
    assert row[at(2)].y_rolling_min_3h == 1.0 and row[at(4)].y_rolling_mean_3h == 4.0


def test_unknown_statistics_and_missing_target(frame):
    df = frame([("a", at(0), 2.0)], READING)
    assert rolling.rolling_features(df, windows=[3], stats=["median", "max"]).columns == [*df.columns, "y_rolling_max_3h"]
    assert rolling.rolling_features(df, target="absent") is df
    assert rolling.rolling_features(df, stats=["median"]) is df
    with pytest.raises(TypeError):
        rolling.rolling_features(df.withColumn("timestamp", F.lit("x")))


def test_initial_window_filters(frame):
    df = rolling.rolling_features(frame([("a", at(h), 1.0) for h in range(10)], READING), windows=[4], stats=["mean", "rows"])
    assert filters.without_initial_window(df, 4).count() == 10  # a partial frame already has a mean
    assert filters.without_initial_window(df, 4, mode="full").count() == 7
    assert filters.without_initial_window(df, 99).count() == 10
    with pytest.raises(ValueError):
        filters.without_initial_window(df, 4, mode="other")


def test_one_shuffle_one_sort(frame):
    df = rolling.rolling_features(frame(series(5), READING), windows=rolling.FEATURE_WINDOWS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


@pytest.mark.parametrize("listed", [0, 1000])
def test_long_keys_by_literal_or_by_join(frame, monkeypatch, listed):
    monkeypatch.setattr("loadcurve.operators.skew.LISTED_KEYS", listed)
    df = frame(series(6), READING)
    for kind in ("rows", "range"):
        options = dict(windows=(3, 24), frame=kind)
        same(rolling.rolling_features(df, max_series_rows=12, **options), rolling.rolling_features(df, **options))


def bounded_ranges(df, windows, include_current):
    hour = 3_600_000_000
    order = Window.partitionBy("unique_id").orderBy(F.unix_micros("timestamp"))
    frames = {n: order.rangeBetween(1 - n * hour, 0) if include_current else order.rangeBetween(-n * hour, -1) for n in windows}
    return rolling._direct_frames(df, frames, "y", [*STATS, "rows"])


@pytest.mark.parametrize("block", [1, 7, 50_000])
@pytest.mark.parametrize("include_current", [True, False])
def test_time_frames_equal_walked_ones(frame, monkeypatch, block, include_current):
    rng = random.Random(block)
    rows = series(4) + [("inf", at(h), rng.choice([math.inf, 1.0, None])) for h in range(30)]
    rows += [("nan", at(h), rng.choice([math.nan, 2.0, None, 5.0])) for h in range(0, 60, 2)]
    df = frame(rows, READING).withColumn("tag", F.lit("kept")).dropDuplicates(["unique_id", "timestamp"])
    monkeypatch.setattr(time_frames, "BLOCK_ROWS", block)
    got = rolling.rolling_features(df, windows=(1, 3, 24, 168), stats=[*STATS, "rows"], frame="range", include_current=include_current)
    want = bounded_ranges(df, (1, 3, 24, 168), include_current)
    assert got.schema == want.schema or [f.name for f in got.schema] == [f.name for f in want.schema] and got.dtypes == want.dtypes

    def cells(out):
        return sorted(
            tuple("nan" if isinstance(v, float) and v != v else round(v, 7) if isinstance(v, float) else str(v) for v in r)
            for r in out.select(*(c for c in out.columns if "stddev" not in c and "mean" not in c or c == "y")).collect()
        )

    assert sorted(map(str, cells(got))) == sorted(map(str, cells(want)))
    finite = lambda out: out.filter("unique_id is null or unique_id not in ('inf', 'nan')")
    same(finite(got), finite(want))


@pytest.mark.parametrize("include_current", [True, False])
def test_time_frames_of_ties_gaps_and_missing_times(frame, monkeypatch, include_current):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *(at(rng.choice([0, 1, 1.5, 30, 5000])) for _ in range(3))]), rng.randint(-5, 5)) for _ in range(300)]
    df = frame(rows, "unique_id string, timestamp timestamp, y int").repartition(3)
    monkeypatch.setattr(time_frames, "BLOCK_ROWS", 10)
    got = rolling.rolling_features(df, windows=(2, 24), stats=["rows", "min", "max", "mean"], frame="range", include_current=include_current)
    want = bounded_ranges(df, (2, 24), include_current).select(got.columns)
    rounded = lambda out: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in out.collect())
    assert got.dtypes == want.dtypes and rounded(got) == rounded(want)


def test_time_frames_keep_precision_far_from_zero(frame):
    rows = [("a", at(i / 60), 1e9 + (i % 7) / 1000) for i in range(2000)] + [("a", at(100 + i / 60), (i % 7) / 1000) for i in range(2000)]
    got = rolling.rolling_features(frame(rows, READING), windows=(3,), stats=["stddev"], frame="range").orderBy("timestamp").collect()
    assert got[-1].y_rolling_stddev_3h == pytest.approx(0.002, rel=0.02)


def test_time_frames_hold_decimals_and_longs(frame):
    df = frame([("a", at(h), 2**60 + h) for h in range(5)], "unique_id string, timestamp timestamp, y long")
    got = rolling.rolling_features(df, windows=(2,), stats=["max"], frame="range").orderBy("timestamp").collect()
    assert [r.y_rolling_max_2h for r in got] == [2**60 + h for h in range(5)]


def burst():
    rng = random.Random(5)
    rows = [("burst", at(i / 4000), rng.uniform(0, 9)) for i in range(3000)]
    return rows + [("same", at(2), float(i)) for i in range(200)] + [("calm", at(h), float(h)) for h in range(30)]


def test_a_burst_within_one_hour_is_cut_by_rows(spark, frame):
    df = frame(burst(), READING)
    layout = skew.lay_out_by_rows(df, "unique_id", "timestamp", 11, 250)
    sizes = {(r.unique_id, r["__chunk"]): r["count"] for r in layout.frame.groupBy("unique_id", "__chunk").count().collect()}
    assert len([k for k in sizes if k[0] == "burst"]) == 12 and max(sizes.values()) <= 250 + 11
    assert layout.frame.filter("not __halo").count() == df.count()
    options = dict(windows=(3, 12), stats=[*STATS, "rows"])
    uncut, cut = (rolling.rolling_features(df, max_series_rows=n, **options) for n in (10_000, 250))
    same(cut.filter("unique_id != 'same'"), uncut.filter("unique_id != 'same'"))
    # rows of one instant have no order of their own, but one and the same in every chunk
    tied = rolling.rolling_features(df.filter("unique_id = 'same'"), max_series_rows=50, **options)
    assert [r.y_rolling_rows_12h for r in tied.orderBy("y_rolling_rows_12h").collect()] == [*range(1, 12), *[12] * 189]


def test_intervals_of_a_burst(frame):
    df = frame(burst(), READING)
    gaps = [sorted(str(r) for r in timeseries.intervals(df, max_series_rows=n).collect()) for n in (10_000, 250)]
    assert gaps[0] == gaps[1]
