"""Rolling statistics of keyed series.

Spark evaluates a bounded frame by going through all its rows again for every record, so frames of
3 to 168 rows cost about 260 updates per record.  Row frames are therefore composed: the state of
a wide frame (count, mean, squared deviations, minimum, maximum) is merged from the states of
narrower frames that end at earlier records, which ``lag`` fetches in constant time.  Frames by time
hold varying numbers of rows; see ``time_frames``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.operators.skew import MAX_SERIES_ROWS, lay_out_by_rows, lay_out_by_time
from loadcurve.operators.time_frames import NUMBERS, time_frames

# The rolling windows (hours) and statistics of the feature set.
DEFAULT_WINDOWS = (3, 6, 12, 24, 168)
FEATURE_WINDOWS = (3, 6, 12, 24, 48, 168)
ROLLING_STATS = {"mean": F.mean, "stddev": F.stddev_samp, "min": F.min, "max": F.max}

# A frame is composed of narrower ones no less than a quarter of its size.
GROWTH = 4


def frame_name(target: str, stat: str, n: int) -> str:
    return f"{target}_rolling_{stat}_{n}h"


def composition(windows: Sequence[int]) -> list[dict[int, list[tuple[int, int]]]]:
    """How to build frames of the given sizes: stages of {size: [(narrower size, offset), ...]}.

    A stage uses only sizes of earlier stages (single records have size 1) and costs one window
    pass.  Helper sizes are put in where the requested ones lie too far apart.
    """
    todo, have, stages = sorted({int(w) for w in windows if w > 1}), [1], []
    while todo:
        limit = GROWTH * have[-1]
        sizes = [w for w in todo if w <= limit] or [limit]
        stage = {}
        for size in sizes:
            parts, offset = [], 0
            for part in reversed(have):
                while size - offset >= part:
                    parts.append((part, offset))
                    offset += part
            stage[size] = parts
        stages.append(stage)
        have += sizes
        todo = [w for w in todo if w > have[-1]]
    return stages


def _total(terms) -> str:
    return " + ".join(terms)


def _merge(parts: list[tuple[int, int]], size: int, fields: Sequence[str]) -> list[str]:
    """SQL for the state of the union of disjoint frames, deviations taken about the joint mean."""
    at = {f: [_state(f, *part) for part in parts] for f in fields}
    exprs = []
    if "n" in fields:
        n, mean = _state("n", size), _state("mean", size)
        exprs.append(_total(f"coalesce({c}, 0)" for c in at["n"]) + f" AS {n}")
        weighted = _total(f"coalesce({c} * {m}, 0D)" for c, m in zip(at["n"], at["mean"]))
        exprs.append(f"try_divide({weighted}, {n}) AS {mean}")
        if "m2" in fields:
            terms = (f"coalesce({d} + {c} * ({m} - {mean}) * ({m} - {mean}), 0D)" for d, c, m in zip(at["m2"], at["n"], at["mean"]))
            exprs.append(_total(terms) + f" AS {_state('m2', size)}")
    if "lo" in fields:
        exprs.append(f"least({', '.join(at['lo'])}) AS {_state('lo', size)}")
        exprs.append(f"greatest({', '.join(at['hi'])}) AS {_state('hi', size)}")
    return exprs


def _state(field: str, size: int, offset: int = 0) -> str:
    return f"__{field}_{size}_{offset}"


def _composed_frames(
    df: DataFrame, order, target: str, windows: Sequence[int], stats: Sequence[str], include_current: bool
) -> DataFrame:
    """Add the columns of row frames to a laid-out frame."""
    fields = []
    if {"mean", "stddev"} & set(stats):
        fields += ["n", "mean"] + (["m2"] if "stddev" in stats else [])
    if {"min", "max"} & set(stats):
        fields += ["lo", "hi"]
    original, y = list(df.columns), f"`{target}`"
    single = {
        "n": f"cast({y} is not null as int)", "mean": f"cast({y} as double)",
        "m2": f"if({y} is null, null, 0D)", "lo": y, "hi": y,
    }

    df = df.selectExpr("*", *(f"{single[f]} AS {_state(f, 1)}" for f in fields))
    for stage in composition(windows) if fields else []:
        kept = [f"`{c}`" for c in df.columns]
        fetched = sorted({part for parts in stage.values() for part in parts if part[1] > 0})
        df = df.withColumns({_state(f, size, at): F.lag(_state(f, size), at).over(order) for size, at in fetched for f in fields})
        df = df.selectExpr(*kept, *(e for size, parts in stage.items() for e in _merge(parts, size, fields)))

    def result(stat: str, n: int) -> str:
        if stat == "rows":
            return f"cast(least(__row - {0 if include_current else 1}, {n}) as bigint)"
        count = _state("n", n)
        return {
            "mean": _state("mean", n),
            "stddev": f"case when {count} > 1 then sqrt({_state('m2', n)} / ({count} - 1)) end",
            "min": _state("lo", n),
            "max": _state("hi", n),
        }[stat]

    if "rows" in stats:
        df = df.withColumn("__row", F.row_number().over(order))
    names = {frame_name(target, s, n): result(s, n) for n in windows for s in stats}
    df = df.selectExpr(*(f"`{c}`" for c in original), *(f"{e} AS `{name}`" for name, e in names.items()))
    if not include_current:
        df = df.withColumns({c: F.lag(c, 1).over(order) for c in names if not c.startswith(f"{target}_rolling_rows_")})
    return df


def _direct_frames(df: DataFrame, frames: dict, target: str, stats: Sequence[str]) -> DataFrame:
    def stat(name: str) -> Column:
        return F.count(F.lit(1)) if name == "rows" else ROLLING_STATS[name](target)

    return df.withColumns({frame_name(target, s, n): stat(s).over(frame) for n, frame in frames.items() for s in stats})


def rolling_features(
    df: DataFrame,
    target: str = "y",
    windows: Sequence[int] = DEFAULT_WINDOWS,
    stats: Sequence[str] = tuple(ROLLING_STATS),
    key: str = "unique_id",
    timestamp: str = "timestamp",
    tiebreak: Sequence[str] = (),
    frame: str = "rows",
    include_current: bool = True,
    max_series_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """Append ``{target}_rolling_{stat}_{N}h`` for every window N and statistic.

    ``frame="rows"`` takes the last N records, which are N hours only in gap-free hourly series;
    ``"range"`` takes the records of the last N hours.  ``include_current=False`` ends the frame
    before the record itself, so that the target does not leak into its own features.  The
    statistic ``rows`` counts the records in the frame; unknown statistics are ignored.
    The rows are shuffled and sorted once.
    """
    known = [s for s in stats if s in ROLLING_STATS or s == "rows"]
    windows = list(dict.fromkeys(windows))
    if not windows or not known or target not in df.columns:
        return df
    if not isinstance(df.schema[timestamp].dataType, T.TimestampType):
        raise TypeError(f"column {timestamp!r} must be a timestamp")
    widest = max(windows)
    if frame == "rows":
        layout = lay_out_by_rows(df, key, timestamp, widest - 1 if include_current else widest, max_series_rows, tiebreak)
        order = Window.partitionBy(*layout.partition_by).orderBy(*layout.order_by)
        return layout.own_rows(_composed_frames(layout.frame, order, target, windows, known, include_current))
    if frame == "range":
        layout = lay_out_by_time(df, key, timestamp, widest * 3600, max_series_rows)
        hour = 3_600_000_000
        if isinstance(df.schema[target].dataType, NUMBERS):
            named = {frame_name(target, s, n): (s, n * hour) for n in windows for s in known}
            widths = [n * hour for n in windows]
            return layout.own_rows(time_frames(layout.frame, layout.partition_by, timestamp, target, named, widths, include_current))
        # wide integers, decimals and values that only have an order
        order = Window.partitionBy(*layout.partition_by).orderBy(F.unix_micros(F.col(timestamp)))
        frames = {
            n: order.rangeBetween(1 - n * hour, 0) if include_current else order.rangeBetween(-n * hour, -1)
            for n in windows
        }
        return layout.own_rows(_direct_frames(layout.frame, frames, target, known))
    raise ValueError("frame is 'rows' or 'range'")
