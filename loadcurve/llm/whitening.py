"""Whitening of embeddings through a weighted multiplicity covariance.

Entries become whole numbers, ``floor(levels * entry)``, so equal vectors are found by grouping.  Each distinct
vector counts once in the fit, with its number of copies or with one as its weight: exact sums give the mean,
centred matrix products per task add up to the covariance, its eigenvectors whiten each distinct vector
once, and rows find their vector's result again by its digest, hot vectors cut by their counts.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are dropped; of vectors of
several lengths the most frequent length stays (the longer one on ties); entries beyond 2^62 levels count as
that; a null id is kept; rows that repeat are all returned; an empty table, or one without usable vectors, gives no
rows.  A component without variance has null in ``whitened`` and takes no part in ``identity_error``; a deviation
beyond a long is null.  Texts do not occur; very long vectors cost their square on the driver.
Extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcurve.llm.columns import picked, type_of
from loadcurve.operators.skew import attach
from loadcurve.session import stored

LEVELS = 256
COMPONENTS = 4
FURTHEST = 1 << 62
# A component with less than this share of the variance has none.
NO_VARIANCE = 1e-12


def packed_rows(x: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Each vector's entries as little-endian integers of the narrowest width of 2, 4 or 8 bytes that holds them all."""
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    widths = np.full(len(lengths), 2)
    for width in (4, 8):
        limit = 1 << (4 * width - 1)
        beyond = np.bincount(row[(x < -limit) | (x >= limit)], minlength=len(lengths)) > 0
        widths[beyond] = width
    if (widths == 2).all():
        offsets = np.r_[0, 2 * ends].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.astype("<i2").tobytes())])
    return pa.array([x[e - n : e].astype(f"<i{w}").tobytes() for e, n, w in zip(ends, lengths, widths)], pa.binary())


def unpacked_rows(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a column again, one per row."""
    rows = column.to_pylist()
    widths = {len(r) // d for r in rows}
    if len(widths) == 1:
        return np.frombuffer(b"".join(rows), f"<i{widths.pop()}").reshape(-1, d).astype(np.int64)
    return np.array([np.frombuffer(r, f"<i{len(r) // d}") for r in rows], np.int64).reshape(-1, d)


def quantized(vectors: DataFrame, levels: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, d, x) of every row with a usable vector of d entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            entries = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)
            broken = np.bincount(row[~np.isfinite(entries)], minlength=len(lengths)) > 0
            good = column.is_valid().to_numpy(zero_copy_only=False) & ~broken & (lengths > 0)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(levels * entries[good[row]]), -FURTHEST, FURTHEST).astype(np.int64)
            kept = pa.array(np.flatnonzero(good))
            columns = [batch.column(0).take(kept), pa.array(lengths[good], pa.int32()), packed_rows(x, lengths[good])]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "d", "x"])

    source = picked(vectors, vec_id=id_col, vector=vector_col)
    return source.mapInArrow(run, f"vec_id {type_of(source, 'vec_id')}, d int, x binary")


def _sums(fit: DataFrame, d: int) -> list[int]:
    """Exact weighted sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            x, w = unpacked_rows(batch.column(0), d), batch.column(1).to_numpy()
            if len(w) and int(np.abs(x).max()) * int(w.sum()) >= FURTHEST:
                x, w = x.astype(object), w.astype(object)
            total = [a + int(b) for a, b in zip(total, (x * w[:, None]).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(str, total), pa.string())], ["i", "s"])

    added = fit.mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return [int(r.s) for r in added.orderBy("i").collect()]


def _covariance(fit: DataFrame, d: int, mean: np.ndarray, n: int) -> np.ndarray:
    """Weighted covariance, entries centred before they are multiplied; each task adds one matrix."""
    i, j = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = unpacked_rows(batch.column(0), d) - mean
            total += x.T @ (x * batch.column(1).to_numpy()[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    v = np.zeros((d, d))
    for a, b, s in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        v[a, b] = v[b, a] = s / n
    return v


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """sum((n * x - S) ^ 2) of each row, in whole numbers; null beyond a long."""
    if not len(x):
        return []
    most = n * int(np.abs(x).max()) + max(map(abs, sums))
    if most * most * x.shape[1] < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    found = (sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in found]


def whitened_rows(
    vectors: DataFrame, components: int = COMPONENTS, weight: str = "one", levels: int = LEVELS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    ``weight`` is what a distinct vector counts in the fit: ``"one"`` or ``"copies"``.  The driver sees the sums,
    the covariance (the square of the vectors' length) and the vectors that hold a large share of the rows.
    """
    if weight not in ("one", "copies"):
        raise ValueError("weight is 'one' or 'copies'")
    rows = quantized(vectors, levels, id_col, vector_col)
    distinct = stored(rows.groupBy("d", "x").agg(F.count(F.lit(1)).alias("copies")))
    counted = F.count(F.lit(1)) if weight == "one" else F.sum("copies")
    usual = distinct.groupBy("d").agg(F.sum("copies").alias("rows"), counted.alias("n")).orderBy(F.desc("rows"), F.desc("d")).first()
    result = (
        f"vec_id {type_of(rows, 'vec_id')}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    if usual is None:
        return vectors.sparkSession.createDataFrame([], result)
    d, n = usual["d"], usual["n"]
    fit = distinct.filter(F.col("d") == d).select("x", (F.lit(1).cast("long") if weight == "one" else F.col("copies")).alias("w"), "copies")
    sums = _sums(fit.select("x", "w"), d)
    mean = np.array([s / n for s in sums])
    v = _covariance(fit.select("x", "w"), d, mean, n)
    values, directions = np.linalg.eigh(v)
    k, trace = min(components, d), float(np.trace(v))
    e, u = values[::-1][:k], directions[:, ::-1][:, :k]
    varies = e > NO_VARIANCE * trace
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, e, 1)), np.nan)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked_rows(batch.column(0), d)
            projected = (x - mean) @ u * scale
            flat = pa.array(projected.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k), pa.int32()), flat)
            columns = [*batch.columns, pa.array(deviations(x, sums, n), pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["x", "w", "copies", "deviation", "whitened"])

    done = fit.mapInArrow(whiten, "x binary, w long, copies long, deviation long, whitened array<double>")
    digest = F.unhex(F.sha2("x", 256)).alias("digest")
    done = stored(done.select(digest, "w", "copies", "deviation", "whitened"))
    error = _identity_error(done, np.flatnonzero(varies).tolist(), n)

    keyed = stored(rows.filter(F.col("d") == d).select("vec_id", digest, F.monotonically_increasing_id().alias("row")))
    table = done.select("digest", "deviation", "whitened")
    joined = attach(keyed, table, ["digest"], "inner", spread_by=["row"], small=False, counts=done.select("digest", "copies"))
    explained = F.array(*(F.lit(float(a / trace) if trace > 0 else None).cast("double") for a in e))
    return joined.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "at").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def _identity_error(done: DataFrame, at: list[int], n: int) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity, over the components with variance."""
    if not at:
        return None
    w, parts = F.col("w"), {i: F.get("whitened", F.lit(i)) for i in at}
    means = done.agg(*(F.sum(w * parts[i]) / n for i in at)).first()
    centred = {i: parts[i] - F.lit(float(m)) for i, m in zip(at, means)}
    pairs = [(i, j) for i in at for j in at if i <= j]
    products = done.agg(*(F.sum(w * centred[i] * centred[j]) / n for i, j in pairs)).first()
    return max(abs(p - (i == j)) for (i, j), p in zip(pairs, products))
