import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import READING, at
from loadcurve.operators import correlation, diagnostics, profile, sampling, timeseries, topk

NAN, INF = float("nan"), float("inf")


@pytest.fixture()
def nulls(frame):
    return frame([("a", v) for v in (None, NAN, -1.0, 0.0, 1.0)] + [("b", 5.0)], "k string, y double")


def test_describe_ignores_missing_values(nulls):
    row = profile.describe(nulls, ["y"]).first()
    values = np.array([-1.0, 0.0, 1.0, 5.0])
    assert row.asDict() == {
        "column": "y", "count": 4, "mean": 1.25, "stddev": pytest.approx(values.std(ddof=1)), "min": -1.0,
        "q25": pytest.approx(-0.25), "q50": pytest.approx(0.5), "q75": pytest.approx(2.0), "max": 5.0,
    }


def test_describe_per_group_and_sketched(nulls):
    per_group = {r.k: r for r in profile.describe(nulls, ["y"], ["k"]).collect()}
    assert per_group["b"].stddev is None and per_group["b"].q50 == 5.0 and per_group["a"]["count"] == 3
    assert profile.describe(nulls, ["y"], exact=False).first().q50 in (0.0, 1.0)


def test_counts_and_missing(nulls):
    c = profile.target_counts(nulls).first()
    assert (c.n_rows, c.n_valid, c.n_null, c.n_non_positive) == (6, 5, 1, 2)
    missing = {r.column: (r.n_missing, r.missing_pct) for r in profile.missing_values(nulls).collect()}
    assert missing == {"k": (0, 0.0), "y": (2, pytest.approx(100 / 3))}
    assert profile.missing_values(nulls.limit(0)).first().missing_pct is None


def test_duplicates(frame):
    df = frame([("a",), ("a",), ("a",), ("b",), (None,), (None,)], "k string")
    assert tuple(profile.duplicate_summary(df, ["k"]).first()) == (2, 5, 3)
    assert tuple(profile.duplicate_summary(df.distinct(), ["k"]).first()) == (0, 0, 0)
    with pytest.raises(ValueError):
        profile.duplicate_summary(df, ["absent"])


def test_negative_counts_skip_text_and_absent_columns(frame):
    df = frame([(-1.0, "x", 0), (2.0, "y", -3)], "rain double, snowfall string, snow_depth int")
    assert {tuple(r) for r in profile.negative_counts(df).collect()} == {("rain", 1), ("snow_depth", 1)}


def test_value_shares_sum_to_all(frame):
    df = frame([("x",)] * 3 + [(None,)], "c string")
    assert {tuple(r) for r in profile.value_shares(df, "c").collect()} == {("x", 3, 75.0), (None, 1, 25.0)}
    assert profile.distinct_values(df, "c").first()[0] == 2


def test_missing_locations(frame):
    rows = [("L", 1.0, "A", "r"), (None, None, "A", "r"), (None, None, "B", None), (None, 2.0, "B", "r")]
    df = frame(rows, "location_id string, latitude double, dataset string, building_class string")
    assert profile.rows_without_location(df).count() == 2
    assert {tuple(r) for r in profile.missing_location_breakdown(df).collect()} == {
        ("dataset", "A", 1, 50.0), ("dataset", "B", 1, 50.0), ("building_class", "r", 1, 50.0), ("building_class", None, 1, 50.0),
    }
    with pytest.raises(ValueError):
        profile.rows_without_location(df.select("dataset"))


def test_boxplot_finds_outliers_and_labels_missing(frame):
    df = frame([("a", float(v)) for v in [*range(1, 9), 100]] + [(None, -1.0), (None, 3.0)], "c string, y double")
    found = {(r.c, r.scale): r for r in profile.boxplot_stats(df, "c", "y", "none").collect()}
    box = found["a", "original"]
    assert (box.q25, box.q50, box.q75) == (3.0, 5.0, 7.0)
    assert (box.whisker_low, box.whisker_high, box.n_outliers) == (1.0, 8.0, 1)
    assert found["none", "original"]["count"] == 2 and found["none", "log1p"]["count"] == 1
    assert found["none", "log1p"].q50 == pytest.approx(math.log1p(3 + 1e-6))
    assert ("none", "original") not in {(r.c, r.scale) for r in profile.boxplot_stats(df, "c", "y").collect()}


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.0, 10.0], [3.0, 3.0], [0.0, 1.0, None, NAN, INF]])
def test_histogram_matches_numpy(frame, values):
    found = profile.histogram(frame([(v,) for v in values], "x double"), "x", 4).orderBy("bin").collect()
    finite = [v for v in values if v is not None and math.isfinite(v)]
    counts, edges = np.histogram(finite, 4)
    assert [r.n for r in found] == list(counts)
    assert [r.bin_start for r in found] == pytest.approx(list(edges[:-1])) and found[-1].bin_end == pytest.approx(edges[-1])
    assert sum(r.n for r in found) == len(finite)


def test_histogram_of_nothing_is_empty(frame):
    assert profile.histogram(frame([(None,)], "x double"), "x").count() == 0


def test_density(frame):
    df = frame([(1.04, 2.0), (0.96, 2.0), (5.0, None)], "latitude double, longitude double")
    assert [tuple(r) for r in profile.location_density(df).collect()] == [(1.0, 2.0, 2)]


def test_top_n_and_other_with_ties(frame):
    df = frame([(f"c{i:02d}",) for i in range(25) for _ in range(1 + i % 3)] + [(None,)] * 9, "c string")
    found = topk.top_n_and_other(df, "c", 10).orderBy("rank").collect()
    assert [r.category for r in found[:3]] == ["NaN", "c02", "c05"]
    assert [r["rank"] for r in found] == list(range(1, 12)) and found[-1].category == "Other"
    assert sum(r["count"] for r in found) == df.count()
    few = topk.top_n_and_other(df, "c", 30)
    assert few.filter("category = 'Other'").count() == 0 and few.count() == 26


def test_orderings(frame):
    df = frame([(2,), (None,), (1,)], "v int")
    assert [r[0] for r in topk.sorted_by(df, "v", nulls_last=True).collect()] == [1, 2, None]
    assert [r[0] for r in topk.sorted_by(df, "v").collect()] == [None, 1, 2]
    ranked = topk.rank_in_group(frame([("a", 3), ("a", 5), ("b", 1)], "k string, v int"), ["k"], [F.desc("v")], 1)
    assert {(r.k, r.v, r["rank"]) for r in ranked.collect()} == {("a", 5, 1), ("b", 1, 1)}


def test_series_sample_is_whole_and_repeatable(frame):
    df = frame([(f"s{i % 20}", at(i), float(i)) for i in range(200)], READING)
    sample = sampling.sample_series(df, n=3, seed=1)
    ids = {r.unique_id for r in sample.collect()}
    assert len(ids) == 3 and sample.count() == 30
    assert {r.unique_id for r in sampling.sample_series(df.repartition(5), n=3, seed=1).collect()} == ids
    assert {r.unique_id for r in sampling.sample_series(df, n=3, seed=2).collect()} != ids
    assert sampling.sample_series(df, n=50).count() == 200
    assert sampling.sample_ids(df, "unique_id", 0).count() == 0


def test_row_sample_report(frame):
    df = frame([(i,) for i in range(2000)], "i int")
    report = sampling.sample_report(df, 0.2).first()
    assert report.n_rows == 2000 and report.n_sampled == sampling.sample_rows(df, 0.2).count()
    assert report.achieved_fraction == pytest.approx(report.n_sampled / 2000) and 0.1 < report.achieved_fraction < 0.3


def test_correlation_matrix_and_strong_pairs(frame):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    data = {"a": x, "b": 2 * x + 1, "c": -x + rng.normal(size=300) * 0.1, "d": rng.normal(size=300)}
    rows = [tuple(float(v[i]) for v in data.values()) for i in range(300)] + [(None, 1.0, 1.0, 1.0)]
    matrix = correlation.correlation_matrix(frame(rows, "a double, b double, c double, d double"), ["a", "b", "c", "d", "absent"])
    found = {(r.column_i, r.column_j): r.r for r in matrix.collect()}
    assert found["a", "c"] == pytest.approx(np.corrcoef(data["a"], data["c"])[0, 1])
    # perfectly collinear columns stay in the report
    assert {(r.column_i, r.column_j) for r in correlation.strong_pairs(matrix).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    with pytest.raises(ValueError):
        correlation.correlation_matrix(matrix, ["r"])


def test_correlation_coerces_text(frame):
    df = frame([("1", 2.0), ("2", 4.0), ("x", 9.0), ("3", 6.0), (None, 1.0)], "y string, m double")
    assert correlation.correlate_with(df, "y", ["m"]).first().r == pytest.approx(1.0)


def test_quality_report(frame):
    df = frame([("a", at(0), NAN), ("a", at(0), 1.0)], READING)
    report = diagnostics.quality_report({"t": df}, {"t": ["unique_id", "timestamp"]}, {"t": "timestamp"})
    found = {(r.check, r.subject): r.value for r in report.collect()}
    assert found["missing", "y"] == "1" and found["duplicate_groups", "unique_id,timestamp"] == "1"
    assert found["first", "timestamp"] == "2024-01-01 00:00:00"


def test_profiles_return_a_schema_on_empty_input(frame):
    empty = frame([], READING)
    for report in (
        profile.describe(empty, ["y"]), profile.target_counts(empty), profile.missing_values(empty),
        profile.duplicate_summary(empty, ["unique_id"]), profile.value_shares(empty, "unique_id"),
        profile.boxplot_stats(empty, "unique_id", "y"), topk.top_n_and_other(empty, "unique_id"),
        timeseries.completeness(empty, "unique_id"), timeseries.intervals(empty), timeseries.resample(empty),
    ):
        assert report.columns and report.count() <= 3


def test_boxplot_keeps_named_categories_in_order(frame):
    rows = [(c, float(v)) for c in "abc" for v in (1, 2, 2, 3, 40)] + [(None, 5.0), ("a", None)]
    boxes = profile.boxplot_stats(frame(rows, "c string, y double"), "c", "y", category_order=["c", "a"]).collect()
    assert [(b.c, b.scale) for b in boxes] == [("c", "original"), ("c", "log1p"), ("a", "original"), ("a", "log1p")]
    assert (boxes[0]["count"], boxes[0].q50, boxes[0].n_outliers, boxes[0].whisker_high) == (5, 2.0, 1, 3.0)
