"""Exact quantiles in two passes, without holding a group's values in one task and without sketches.

The first pass draws a bounded random sample of each group's values and sets a bracket around each wanted
rank.  The second counts what lies below, between and above the brackets and keeps the few different values
inside them, which settle the ranks.  Where a bracket misses its rank, which the counts tell, or keeps more
values than one task should hold, the value is narrowed down in rounds: each counts values in a bounded number
of buckets, combined map-side, and goes on with the one bucket that holds the rank.  Doubles are told apart
after four rounds of 65,536.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcurve.operators.skew import attach, fits_broadcast
from loadcurve.session import stored

# Values drawn per group, and standard deviations of their share that a bracket spans to either side.
SAMPLE = 16_384
SPREAD = 4.5
# Different values inside a group's brackets that one task may put in order.
GATHERED = 250_000
BUCKETS = 65_536
# The first round cuts each power of two into this many buckets, whatever the range of the values.
BUCKETS_PER_OCTAVE = 32
# What then remains of the 53 bits of a double.
BITS_LEFT = 48


def quantile_names(probabilities: Sequence[float]) -> list[str]:
    return [f"q{round(p * 100)}" for p in probabilities]


def _magnitude_bucket(v: Column) -> Column:
    """Buckets of equal ratio in the order of the values; zero and the infinities have their own."""
    size = F.floor(F.log2(F.abs(v)) * BUCKETS_PER_OCTAVE) + 40_000
    size = F.when(F.abs(v) == float("inf"), 100_000).otherwise(size)
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size)


def _brackets(
    df: DataFrame, by: Sequence[str], value: str, weight: str | None, probabilities: Sequence[float],
    buckets: int, rounds: int, few_groups: bool | None,
) -> DataFrame:
    """(by..., i, pos, rank, c, lo, hi, next): the values lo to hi among which the rank of each position lies.

    ``rank`` counts from the first of the ``c`` values of the bracket, ``next`` is the value beyond it.
    """
    v = F.col(value)
    count = F.lit(1) if weight is None else F.col(weight)
    clean = df.filter(v.isNotNull() & ~F.isnan(v)).select(
        # one zero, so that equal values have one rank
        *by, (v + F.lit(0.0)).alias("__v"), count.cast("long").alias("__w")
    )
    if few_groups is None:
        few_groups = fits_broadcast(clean.select(*by).distinct())

    def counted(rows: DataFrame, keys: list[str], bucket: Column, *kept: Column) -> DataFrame:
        cells = rows.groupBy(*keys, bucket.alias("__b")).agg(
            F.sum("__w").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), *kept
        )
        order = Window.partitionBy(*keys).orderBy("__b")
        # a group's cells are bounded, so one exchange serves the window and the grouping that follows
        return cells.repartition(*by).withColumns(
            {
                "__end": F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)),
                "__after": F.lead("__lo").over(order),
            }
        )

    groups = list(by)
    first = counted(clean, groups, _magnitude_bucket(F.col("__v")))
    ranks = F.array(*(F.struct(F.lit(i).alias("__i"), F.lit(p).alias("__p")) for i, p in enumerate(probabilities)))
    found = (
        first.withColumn("__n", F.sum("__c").over(Window.partitionBy(*groups)))
        .select("*", F.inline(ranks))
        .withColumn("__pos", F.col("__p") * (F.col("__n") - 1))
        .withColumn("__rank", F.floor("__pos") - (F.col("__end") - F.col("__c")))
        .filter((F.col("__rank") >= 0) & (F.col("__rank") < F.col("__c")))
        .select(*groups, "__i", "__pos", "__rank", "__c", "__lo", "__hi", F.col("__after").alias("__next"))
    )
    for _ in range(rounds - 1):
        limits = [
            F.max(F.when(F.col("__i") == i, F.col(c))).alias(f"{c}{i}")
            for i in range(len(probabilities)) for c in ("__lo", "__hi")
        ]
        targets = found.groupBy(*groups).agg(
            F.collect_list(F.struct("__i", "__pos", "__rank", "__next", "__lo", "__hi")).alias("__t"), *limits
        )
        placed = attach(clean, targets, groups, "inner", spread_by=["__v"], null_safe=True, small=few_groups)
        # most values are in no bracket; plain comparisons drop them before the ranks are told apart
        near = " or ".join(f"__v between __lo{i} and __hi{i}" for i in range(len(probabilities)))
        hits = placed.filter(near).select(
            *groups, "__v", "__w",
            F.expr("inline(filter(__t, t -> __v >= t.__lo and __v <= t.__hi))").alias("__i", "__pos", "__rank", "__next", "__lo", "__hi"),
        )
        share = F.when(F.col("__hi") > F.col("__lo"), (F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
        bucket = F.coalesce(F.least(F.floor(share * buckets), F.lit(buckets - 1)), F.lit(0))
        cells = counted(
            hits, [*groups, "__i"], bucket,
            F.max("__pos").alias("__pos"), F.max("__rank").alias("__rank"), F.max("__next").alias("__next"),
        )
        found = (
            cells.withColumn("__rank", F.col("__rank") - (F.col("__end") - F.col("__c")))
            .filter((F.col("__rank") >= 0) & (F.col("__rank") < F.col("__c")))
            .select(
                *groups, "__i", "__pos", "__rank", "__c", "__lo", "__hi",
                F.coalesce("__after", "__next").alias("__next"),
            )
        )
    return found


def approximate_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float],
    buckets: int = BUCKETS, few_groups: bool | None = None,
) -> DataFrame:
    """One row per group with data values within a 2,000,000th of those at the ranks, from two rounds.

    Null and NaN values are ignored.
    """
    names = quantile_names(probabilities)
    found = _brackets(df, by, value, None, [float(p) for p in probabilities], buckets, 2, few_groups)
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("__i") == i, F.col("__lo"))).alias(n) for i, n in enumerate(names)))


def _narrowed(
    df: DataFrame, by: Sequence[str], value: str, weight: str | None, probabilities: Sequence[float],
    buckets: int, few_groups: bool | None,
) -> DataFrame:
    """Quantiles by rounds of buckets alone."""
    rounds = 1 + math.ceil(BITS_LEFT / math.log2(buckets))
    found = _brackets(df, by, value, weight, probabilities, buckets, rounds, few_groups)
    here = F.expr(
        "case when __lo = __hi then __lo else cast(raise_error('bracket with several values') as double) end"
    )
    # the value at the next rank is the same one, or the first beyond the bracket
    there = F.when((F.col("__rank") + 1 < F.col("__c")) | F.col("__next").isNull(), here).otherwise(F.col("__next"))
    return _interpolated(found, by, probabilities, here, there)


def _interpolated(found: DataFrame, by: Sequence[str], probabilities: Sequence[float], here: Column, there: Column) -> DataFrame:
    part = F.col("__pos") - F.floor("__pos")
    at = F.when((part == 0) | (here == there), here).otherwise(here + (there - here) * part)
    names = quantile_names(probabilities)
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("__i") == i, at)).alias(n) for i, n in enumerate(names)))


def _sampled_brackets(clean: DataFrame, by: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(by..., __n, __lo0, __hi0, ...): a group's rows and, per probability, values that its rank most likely lies between.

    Rows are dealt into ``SAMPLE`` cells at random; each keeps one value, drawn by weight, and counts its rows.
    """
    drawn = clean.withColumns(
        {"__race": -F.log1p(-F.rand(1)) / F.col("__w"), "__cell": F.floor(F.rand(2) * SAMPLE)}
    )
    cells = drawn.groupBy(*by, "__cell").agg(F.min_by("__v", "__race").alias("__v"), F.sum("__w").alias("__c"))
    # a group's cells are bounded
    group = Window.partitionBy(*by)
    placed = cells.withColumns(
        {
            "__end": F.sum("__c").over(group.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)),
            "__n": F.sum("__c").over(group),
            "__m": F.count(F.lit(1)).over(group),
        }
    )
    limits = []
    for i, p in enumerate(probabilities):
        rank = p * (F.col("__n") - 1)
        slack = F.col("__n") * (SPREAD * F.sqrt(p * (1 - p) * (1 / F.col("__m") + 1 / F.col("__n"))) + SPREAD / F.col("__m"))
        below, above = F.col("__end") <= rank - slack, F.col("__end") - F.col("__c") >= rank + slack + 1
        limits.append(F.coalesce(F.max(F.when(below, F.col("__v"))), F.lit(float("-inf"))).alias(f"__lo{i}"))
        limits.append(F.coalesce(F.min(F.when(above, F.col("__v"))), F.lit(float("inf"))).alias(f"__hi{i}"))
    return placed.groupBy(*by).agg(F.first("__n").alias("__n"), *limits)


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    buckets: int = BUCKETS,
    few_groups: bool | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per group with linearly interpolated quantiles of a double column.

    Null and NaN values are ignored.  ``by`` needs at least one column.  ``few_groups`` says whether
    the groups are known to be few; if left open they are measured.  ``weight`` names a column of
    whole numbers, how often each row counts.  The input is read twice when the frame is built; brackets and
    counts are stored in the shared folder.  ``buckets`` is for the rounds that follow where those do not do.
    """
    probabilities, by = [float(p) for p in probabilities], list(by)
    v = F.col(value)
    count = F.lit(1) if weight is None else F.col(weight)
    clean = df.filter(v.isNotNull() & ~F.isnan(v)).select(*by, (v + F.lit(0.0)).alias("__v"), count.cast("long").alias("__w")).filter("__w > 0")
    # stored: later tasks must see the same random draw
    brackets = stored(_sampled_brackets(clean, by, probabilities))
    placed = attach(
        clean, brackets, by, "inner", spread_by=["__v"], null_safe=True, small=few_groups, counts=brackets.select(*by, "__n")
    )
    some = range(len(probabilities))
    inside = F.greatest(*((F.col("__v") >= F.col(f"__lo{i}")) & (F.col("__v") <= F.col(f"__hi{i}")) for i in some), F.lit(False))
    passed = sum((F.when(F.col("__v") > F.col(f"__hi{i}"), 1).otherwise(0) for i in some), F.lit(0))
    # a value inside has a row of its own, what lies between two brackets one row together
    cells = placed.groupBy(*by, passed.alias("__gap"), F.when(inside, F.col("__v")).alias("__at")).agg(
        F.sum("__w").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
    )
    cells = stored(cells.drop("__gap", "__at"))
    ranks = [F.floor(p * (F.col("__n") - 1)) for p in probabilities]
    known = attach(cells, brackets, by, "inner", spread_by=["__lo"], null_safe=True, small=few_groups)
    state = known.groupBy(*by, "__n").agg(
        F.count(F.lit(1)).alias("__cells"),
        *(F.sum(F.when(F.col("__hi") < F.col(f"__lo{i}"), F.col("__c")).otherwise(0)).alias(f"__below{i}") for i in some),
        *(F.sum(F.when(F.col("__lo") <= F.col(f"__hi{i}"), F.col("__c")).otherwise(0)).alias(f"__through{i}") for i in some),
    )
    held = F.least(*((F.col(f"__below{i}") <= r) & (r < F.col(f"__through{i}")) for i, r in enumerate(ranks)), F.lit(True))
    state = stored(state.select(*by, "__n", "__cells", held.alias("__held")))
    most, missed = state.agg(F.max("__cells"), F.count_if(~F.col("__held"))).first()
    good = cells
    if missed:
        good = attach(cells, state.filter("__held").select(*by), by, "inner", spread_by=["__lo"], null_safe=True, small=few_groups)
    if most is None or most <= GATHERED:
        result = _in_order(good, by, probabilities)
    else:  # the least value stands for a row of several: no rank lies among its others
        result = _narrowed(good, by, "__lo", "__c", probabilities, buckets, few_groups)
    if not missed:
        return result
    rest = attach(clean, state.filter(~F.col("__held")).select(*by), by, "inner", spread_by=["__v"], null_safe=True, small=few_groups)
    return result.unionByName(_narrowed(rest, by, "__v", "__w", probabilities, buckets, few_groups))


def _in_order(cells: DataFrame, by: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Quantiles from counted values whose number per group is bounded."""
    group = Window.partitionBy(*by)
    order = group.orderBy("__lo")
    ranks = F.array(*(F.struct(F.lit(i).alias("__i"), F.lit(p).alias("__p")) for i, p in enumerate(probabilities)))
    found = (
        cells.withColumns(
            {
                "__end": F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)),
                "__next": F.lead("__lo").over(order),
                "__n": F.sum("__c").over(group),
            }
        )
        .select("*", F.inline(ranks))
        .withColumn("__pos", F.col("__p") * (F.col("__n") - 1))
        .withColumn("__rank", F.floor("__pos") - (F.col("__end") - F.col("__c")))
        .filter((F.col("__rank") >= 0) & (F.col("__rank") < F.col("__c")))
    )
    there = F.when((F.col("__rank") + 1 < F.col("__c")) | F.col("__next").isNull(), F.col("__lo")).otherwise(F.col("__next"))
    return _interpolated(found, by, probabilities, F.col("__lo"), there)
