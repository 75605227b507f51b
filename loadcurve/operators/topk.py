"""Orderings and top-k reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadcurve.functions.scalars import label_or


def sorted_by(df: DataFrame, *columns: str, nulls_last: bool = False) -> DataFrame:
    """Total order for a final report."""
    return df.orderBy(*(F.col(c).asc_nulls_last() if nulls_last else F.col(c).asc() for c in columns))


def top_k(df: DataFrame, k: int, by: str, ties: Sequence[str]) -> DataFrame:
    """The k rows with the largest ``by``; ``ties`` makes the choice unique."""
    return df.orderBy(F.desc(by), *(F.asc(t) for t in ties)).limit(k)


def top_categories(df: DataFrame, category: str, n: int, missing_label: str | None = None) -> DataFrame:
    """The n most frequent categories with their row counts."""
    label = label_or(F.col(category), missing_label) if missing_label else F.col(category)
    counts = df.groupBy(label.alias(category)).agg(F.count(F.lit(1)).alias("count"))
    return top_k(counts, n, "count", [category])


def top_n_and_other(
    df: DataFrame, category: str, n: int = 10, other: str = "Other", missing_label: str = "NaN"
) -> DataFrame:
    """Counts of the n most frequent categories, the rest pooled under ``other``: (category, count, rank)."""
    counts = df.groupBy(label_or(F.col(category), missing_label).alias("category")).agg(F.count(F.lit(1)).alias("count"))
    # the ranking window covers at most n rows
    top = top_k(counts, n, "count", ["category"]).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("count"), F.asc("category")))
    )
    placed = counts.join(F.broadcast(top.select("category", "rank")), "category", "left")
    return placed.groupBy(
        F.when(F.col("rank").isNull(), F.lit(other)).otherwise(F.col("category")).alias("category"),
        F.coalesce("rank", F.lit(n + 1)).alias("rank"),
    ).agg(F.sum("count").alias("count"))


def rank_in_group(df: DataFrame, group: Sequence[str], order_by: Sequence, n: int) -> DataFrame:
    """The first n rows of each group with their rank."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order_by))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)
