import math
import random

import numpy as np
import pytest

from loadcurve.operators import quantiles
from loadcurve.operators.quantiles import approximate_quantiles, exact_quantiles

PROBABILITIES = [0.25, 0.5, 0.75]


def expected(values):
    return np.quantile(np.array(values), PROBABILITIES)


def draw(kind, n, rng):
    if kind == "ties":
        return [float(rng.choice([1, 2, 2, 2, 3])) for _ in range(n)]
    if kind == "heavy tail":
        return [rng.paretovariate(0.6) for _ in range(n)]
    if kind == "constant":
        return [7.0] * n
    return [rng.gauss(0, 1) for _ in range(n)]


@pytest.mark.parametrize("buckets, few_groups", [(1024, False), (4096, True), (65_536, None)])
def test_equals_interpolated_quantiles(frame, buckets, few_groups):
    rng = random.Random(buckets)
    groups = {
        f"{kind} {n}": draw(kind, n, rng)
        for kind in ("ties", "heavy tail", "constant", "normal")
        for n in (1, 2, 3, 4, 5, 7, 50, 1001, 4000)
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [(None, 1.0), (None, 3.0), ("ties 1", None), ("ties 1", float("nan"))]
    rng.shuffle(rows)
    df = frame(rows, "g string, v double").repartition(7)
    found = {r.g: r for r in exact_quantiles(df, ["g"], "v", PROBABILITIES, buckets, few_groups).collect()}
    assert found.keys() == groups.keys() | {None}
    assert found[None].q50 == 2.0
    for g, values in groups.items():
        assert [found[g].q25, found[g].q50, found[g].q75] == pytest.approx(list(expected(values))), g


def test_extreme_probabilities(frame):
    values = [float(i) for i in range(1000)]
    row = exact_quantiles(frame([("a", v) for v in values], "g string, v double"), ["g"], "v", [0.0, 0.99, 1.0], 4096).first()
    assert (row.q0, row.q99, row.q100) == (0.0, pytest.approx(np.quantile(values, 0.99)), 999.0)


def test_approximation_returns_data_values(frame):
    values = [float(i) for i in range(101)]
    row = approximate_quantiles(frame([("a", v) for v in values], "g string, v double"), ["g"], "v", PROBABILITIES).first()
    assert {row.q25, row.q50, row.q75} <= set(values) and row.q50 == 50.0


def test_neighbouring_doubles_signs_and_infinities(frame):
    values = [-math.inf, -1e300, -5e-324, -0.0, 0.0, 5e-324, 1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 3) + 1e-15, 1e300, math.inf]
    probabilities = [i / 10 for i in range(11)]
    row = exact_quantiles(frame([("a", v) for v in values], "g string, v double"), ["g"], "v", probabilities).first()
    assert list(row)[1:] == values


def test_weights_count_rows_several_times(frame):
    rows = [("a", 1.0, 3), ("a", 5.0, 1), ("b", 2.0, 1), ("b", 4.0, 1)]
    df = frame(rows, "g string, v double, n long")
    found = {r.g: r for r in exact_quantiles(df, ["g"], "v", PROBABILITIES, weight="n").collect()}
    assert list(found["a"])[1:] == list(expected([1.0, 1.0, 1.0, 5.0])) and list(found["b"])[1:] == [2.5, 3.0, 3.5]


def test_one_group_over_many_partitions(frame):
    values = [float(i * i % 9973) / 7 for i in range(5000)]
    df = frame([("a", v) for v in values], "g string, v double").repartition(60)
    row = exact_quantiles(df, ["g"], "v", PROBABILITIES, few_groups=True).first()
    assert list(row)[1:] == pytest.approx(list(expected(values)))


def test_no_rows(frame):
    assert exact_quantiles(frame([], "g string, v double"), ["g"], "v", PROBABILITIES).count() == 0


@pytest.mark.parametrize("setting, value", [("SPREAD", -3.0), ("SPREAD", 0.0), ("GATHERED", 5), ("SAMPLE", 16)])
def test_missed_and_crowded_brackets(frame, monkeypatch, setting, value):
    """Brackets that miss, hold too many values or come from a tiny sample cost rounds, not exactness."""
    rng = random.Random(8)
    groups = {f"{kind} {n}": draw(kind, n, rng) for kind in ("ties", "heavy tail", "normal") for n in (1, 6, 3000)}
    df = frame([(g, v) for g, values in groups.items() for v in values], "g string, v double").repartition(5)
    monkeypatch.setattr(quantiles, setting, value)
    for row in exact_quantiles(df, ["g"], "v", PROBABILITIES).collect():
        assert [row.q25, row.q50, row.q75] == pytest.approx(list(expected(groups[row.g]))), row.g


def test_input_is_read_twice_and_few_values_are_kept(spark, frame, monkeypatch):
    rng = random.Random(9)
    values = [rng.gauss(0, 1) for _ in range(60_000)]
    read, kept = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = frame([("a", v) for v in values], "g string, v double").mapInArrow(counted, "g string, v double")
    monkeypatch.setattr(quantiles, "_in_order", lambda cells, *rest: kept.append(cells.count()) or in_order(cells, *rest))
    row = exact_quantiles(df, ["g"], "v", PROBABILITIES, few_groups=True).first()
    assert list(row)[1:] == pytest.approx(list(expected(values)))
    assert read.value == 2 * len(values)
    assert kept[0] < len(values) / 6


in_order = quantiles._in_order
