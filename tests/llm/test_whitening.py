"""Whitening against NumPy over the distinct vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcurve.llm.whitening import deviations, packed_rows, unpacked_rows, whitened_rows

SF = "/root/testdata/sf0.001"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def check(df, rows, weight="one", components=4):
    """``rows`` are (vec_id, usable vector) of one length."""
    x = [tuple(math.floor(256 * c) for c in v) for _, v in rows]
    distinct = sorted(set(x))
    w = np.array([1 if weight == "one" else x.count(v) for v in distinct])
    n, d = int(w.sum()), len(distinct[0])
    sums = [sum(int(k) * v[i] for k, v in zip(w, distinct)) for i in range(d)]
    centred = np.array(distinct, float) - np.array([s / n for s in sums])
    v = (centred * w[:, None]).T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = df.collect()
    assert df.columns == COLUMNS and dict(df.dtypes)["component"] == "int" and dict(df.dtypes)["deviation"] == "bigint"
    assert sorted(((r.vec_id, r.component) for r in out), key=repr) == sorted(((i, k + 1) for i, _ in rows for k in range(min(components, d))), key=repr)
    position = {v: i for i, v in enumerate(distinct)}
    projected = centred @ u / np.sqrt(e)
    by_id = {}
    for (i, _), q in zip(rows, x):
        by_id.setdefault(i, set()).add(q)
    signs = {}
    for r in out:
        k = r.component - 1
        assert r.n == n and r.explained == pytest.approx(e[k] / np.trace(v), rel=1e-9) and r.identity_error < 1e-6
        matches = [q for q in by_id[r.vec_id] if r.deviation == sum((n * a - s) ** 2 for a, s in zip(q, sums))]
        assert matches
        if len(by_id[r.vec_id]) == 1:
            want = projected[position[matches[0]], k]
            if abs(want) > 1e-6:
                sign = signs.setdefault(k, math.copysign(1, want * r.whitened))
                assert r.whitened == pytest.approx(sign * want, rel=1e-6, abs=1e-8)


def test_given_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect() if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(whitened_rows(vectors), rows)
    check(whitened_rows(vectors, weight="copies", components=2), rows, "copies", 2)


def test_odd_rows(spark):
    rng = random.Random(4)
    good = [(rng.choice([None, *range(60)]), [rng.uniform(-1, 1) for _ in range(3)]) for _ in range(50)]
    hot = [(7, [0.5, -0.0, 3.0])] * 60 + [(None, [-0.001, 0.25, 140.0])] * 40
    bad = [(1, None), (2, []), (3, [0.1, None, 0.2]), (4, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 1.0, 1.0]), (6, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(good + hot + bad, schema).withColumns({"x": F.lit(1), "d": F.lit(2), "n": F.lit(3), "row": F.lit(4)})
    check(whitened_rows(df), good + hot)
    check(whitened_rows(df, weight="copies"), good + hot, "copies")
    check(whitened_rows(df.withColumn("embedding", F.col("embedding").cast("array<float>"))), [(i, [float(np.float32(c)) for c in v]) for i, v in good + hot])


def test_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitened_rows(spark.createDataFrame([], schema)).collect() == []
    assert whitened_rows(spark.createDataFrame([(1, None), (2, [])], schema)).columns == COLUMNS
    same = whitened_rows(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(same) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, None)}
    flat = whitened_rows(spark.createDataFrame([(i, [float(i), 2.0]) for i in range(4)], schema)).collect()
    assert {r.whitened is None for r in flat if r.component == 2} == {True} and {r.whitened is None for r in flat if r.component == 1} == {False}


def test_widths_and_exact_deviations():
    x = np.array([1, -2, 40_000, 3, -(1 << 40), 5, 32_767, -32_768])
    packed = packed_rows(x, np.array([2, 2, 2, 2]))
    assert [len(p.as_py()) for p in packed] == [4, 8, 16, 4]
    assert unpacked_rows(packed, 2).tolist() == x.reshape(4, 2).tolist()
    assert deviations(np.array([[1, 2], [3, 4]]), [4, 6], 2) == [8, 8]
    assert deviations(np.array([[1 << 40, 0]]), [0, 0], 1) == [None]
    assert deviations(np.array([[1 << 31, 5]]), [0, 0], 1) == [(1 << 62) + 25]
