"""Statistics of frames that reach back a fixed time, in time that does not grow with the rows of a frame.

Spark goes through a bounded frame again for every record.  Here sorted series stream through tasks in
blocks.  The states (count, mean, squared deviations, least and greatest value) of the last 1, 2, 4, ... rows before
each row are built from one another, and the frame of a row is put together from the powers of two in
its length, for all rows and frames of a block at once.  A block starts with the rows that its frames reach back to
and is at least half as long as those, so the work per row stays logarithmic in the frame's rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Rows of a block at least.
BLOCK_ROWS = 50_000
NUMBERS = (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)


def frame_bounds(at: np.ndarray, width: int, include_current: bool, lone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and row behind the last one of each row's frame; ``lone`` rows see those of their instant."""
    first, behind = np.searchsorted(at, at, "left"), np.searchsorted(at, at, "right")
    if include_current:
        low, high = np.searchsorted(at, at - width, "right"), behind
    else:
        low, high = np.searchsorted(at, at - width, "left"), first
    return np.where(lone, first, low), np.where(lone, behind, high)


def frame_states(y: np.ndarray, valid: np.ndarray, bounds: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[dict[str, np.ndarray]]:
    """count, mean, m2, lo and hi of the rows between each pair of bounds, one dictionary per pair of arrays."""
    rows = len(y)
    seen = np.r_[0, np.cumsum(valid)]
    odd = np.r_[0, np.cumsum(valid & np.isnan(y))]
    mean, m2 = np.where(valid, y, 0.0), np.zeros(rows)
    # NaN is greater than all other values
    lo, hi = np.where(valid & ~np.isnan(y), y, np.inf), np.where(valid, y, -np.inf)
    found = []
    for low, high in bounds:
        found.append({"mean": np.zeros(len(low)), "m2": np.zeros(len(low)), "lo": np.full(len(low), np.inf), "hi": np.full(len(low), -np.inf)})
    # what is left of each frame: its rows before ``end`` are still to be added
    ends = [high.copy() for _, high in bounds]
    counts = [np.zeros(len(low), np.int64) for low, _ in bounds]
    lengths = [np.maximum(high - low, 0) for low, high in bounds]
    longest = max((int(n.max(initial=0)) for n in lengths), default=0)
    size = 1
    while size <= longest:
        for state, end, count, length in zip(found, ends, counts, lengths):
            some = np.flatnonzero(length & size)
            if not len(some):
                continue
            last = end[some] - 1
            more = seen[last + 1] - seen[np.maximum(last + 1 - size, 0)]
            _merge(state, some, count[some], more, mean[last], m2[last], lo[last], hi[last])
            count[some] += more
            end[some] -= size
        # states of twice as many rows; those that would begin before the block are never asked for
        now, before = np.arange(size, rows), np.arange(rows - size)
        here = seen[now + 1] - seen[now + 1 - size]
        there = seen[before + 1] - seen[np.maximum(before + 1 - size, 0)]
        wide = {"mean": mean.copy(), "m2": m2.copy(), "lo": lo.copy(), "hi": hi.copy()}
        _merge(wide, now, here, there, mean[before], m2[before], lo[before], hi[before])
        mean, m2, lo, hi = wide["mean"], wide["m2"], wide["lo"], wide["hi"]
        size *= 2
    for state, (low, high), count in zip(found, bounds, counts):
        state["n"], state["rows"] = count, np.maximum(high - low, 0)
        all_odd = (count > 0) & (odd[np.maximum(high, low)] - odd[low] == count)
        state["lo"][all_odd] = np.nan
    return found


def _merge(state: dict[str, np.ndarray], at: np.ndarray, own: np.ndarray, n: np.ndarray, mean, m2, lo, hi) -> None:
    """Add disjoint rows' states to those at the given places; deviations are taken about the joint mean."""
    base = state["mean"][at]
    total = np.maximum(own + n, 1)
    joint = (base * own + mean * n) / total
    state["m2"][at] += m2 + np.where(own > 0, own * (base - joint) ** 2, 0) + np.where(n > 0, n * (mean - joint) ** 2, 0)
    state["mean"][at] = joint
    state["lo"][at] = np.minimum(state["lo"][at], lo)
    state["hi"][at] = np.maximum(state["hi"][at], hi)


class SeriesStream:
    """Turns batches of sorted series into blocks with their frames' statistics."""

    def __init__(self, keys: Sequence[str], timestamp: str, target: str, widths: Sequence[int], include_current: bool):
        self.keys, self.timestamp, self.target = list(keys), timestamp, target
        self.widths, self.include_current, self.reach = list(widths), include_current, max(widths)
        self.context = 0  # rows kept only because later frames reach back to them
        self.step, self.y = np.empty(0, np.int64), np.empty(0)  # step: time since the row before, a series' first row far away
        self.valid, self.lone = np.empty(0, bool), np.empty(0, bool)
        self.waiting: list[pa.RecordBatch] = []
        self.last_keys: list[pa.Array] | None = None
        self.last_time = 0

    def add(self, batch: pa.RecordBatch) -> None:
        columns = [batch.column(k) for k in self.keys]
        starts = np.zeros(batch.num_rows, bool)
        for i, column in enumerate(columns):
            if self.last_keys is not None:
                column = pa.concat_arrays([self.last_keys[i], column])
            now, before = column.slice(1), column.slice(0, len(column) - 1)
            differs = pc.if_else(
                pc.and_(now.is_valid(), before.is_valid()), pc.fill_null(pc.not_equal(now, before), False), pc.not_equal(now.is_valid(), before.is_valid())
            ).to_numpy(zero_copy_only=False)
            starts |= differs if self.last_keys is not None else np.r_[True, differs]
        self.last_keys = [c.slice(batch.num_rows - 1) for c in columns]
        stamps = batch.column(self.timestamp)
        lone = stamps.is_null().to_numpy(zero_copy_only=False)
        time = pc.fill_null(stamps.cast(pa.timestamp("us", stamps.type.tz)).cast(pa.int64()), 0).to_numpy()
        far = self.reach + 1
        step = np.diff(time, prepend=self.last_time)
        was_lone = np.r_[self.lone[-1:] if len(self.lone) else [False], lone[:-1]]
        step = np.where(starts | (lone != was_lone), far, np.where(lone, 0, np.minimum(step, far)))
        self.last_time = int(time[-1])
        values = batch.column(self.target)
        self.step, self.lone = np.r_[self.step, step], np.r_[self.lone, lone]
        self.valid = np.r_[self.valid, values.is_valid().to_numpy(zero_copy_only=False)]
        self.y = np.r_[self.y, pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy()]
        self.waiting.append(batch)

    def full(self) -> bool:
        return len(self.y) - self.context >= max(BLOCK_ROWS, self.context // 2)

    def flush(self, final: bool) -> Iterator[tuple[pa.RecordBatch, list[dict[str, np.ndarray]]]]:
        """Rows whose frames are complete with their states; the last instant waits unless this is the end."""
        if not self.waiting:
            return
        at = np.cumsum(self.step)
        done = len(at) if final else int(np.searchsorted(at, at[-1], "left"))
        if done > self.context:
            bounds = [tuple(b[self.context : done] for b in frame_bounds(at, w, self.include_current, self.lone)) for w in self.widths]
            states = frame_states(self.y, self.valid, bounds)
            rows = pa.Table.from_batches(self.waiting)
            ready = rows.slice(0, done - self.context).combine_chunks()
            offset = 0
            for batch in ready.to_batches():
                yield batch, [{k: v[offset : offset + batch.num_rows] for k, v in s.items()} for s in states]
                offset += batch.num_rows
            self.waiting = rows.slice(done - self.context).to_batches()
        else:
            done = self.context
        keep = min(done, int(np.searchsorted(at, at[-1] - self.reach, "left")))
        self.context = done - keep
        self.step, self.y = self.step[keep:].copy(), self.y[keep:]
        self.valid, self.lone = self.valid[keep:], self.lone[keep:]


def time_frames(
    df: DataFrame, partition_by: Sequence[str], timestamp: str, target: str, frames: dict[str, tuple[str, int]],
    widths: Sequence[int], include_current: bool,
) -> DataFrame:
    """Add columns ``{name: (statistic, width in microseconds)}`` over frames within each partition.

    One shuffle and one sort; statistics are rows, mean, stddev, min and max, as Spark defines them for range
    frames: rows of the same instant belong to each other's frames if ``include_current``.
    """
    order, value_type = list(widths), df.schema[target].dataType
    kinds = {"rows": T.LongType(), "mean": T.DoubleType(), "stddev": T.DoubleType(), "min": value_type, "max": value_type}
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, kinds[stat]) for name, (stat, _) in frames.items())])
    arrow = {"rows": pa.int64(), "mean": pa.float64(), "stddev": pa.float64()}
    narrow = {T.FloatType: pa.float32(), T.IntegerType: pa.int32(), T.ShortType: pa.int16(), T.ByteType: pa.int8()}
    arrow["min"] = arrow["max"] = narrow.get(type(value_type), pa.float64())
    names = [*df.columns, *frames]

    def column(stat: str, state: dict[str, np.ndarray]) -> pa.Array:
        n = state["n"]
        if stat == "rows":
            return pa.array(state["rows"])
        if stat == "stddev":
            return pa.array(np.sqrt(state["m2"] / np.maximum(n - 1, 1)), mask=n < 2)
        value = state[{"mean": "mean", "min": "lo", "max": "hi"}[stat]]
        return pa.array(np.where(n > 0, value, 0), mask=n == 0).cast(arrow[stat], safe=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = SeriesStream(partition_by, timestamp, target, order, include_current)

        def finished(final: bool) -> Iterator[pa.RecordBatch]:
            for batch, states in stream.flush(final):
                added = [column(stat, states[order.index(width)]) for stat, width in frames.values()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

        with np.errstate(invalid="ignore", over="ignore"):
            for batch in batches:
                if batch.num_rows:
                    stream.add(batch)
                if stream.full():
                    yield from finished(False)
            yield from finished(True)

    laid_out = df.repartition(*partition_by).sortWithinPartitions(*partition_by, timestamp)
    return laid_out.mapInArrow(run, schema)
