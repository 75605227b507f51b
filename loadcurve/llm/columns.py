"""Column selection shared by the operators: inputs keep extra columns of any name out of the way."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; ``picked(df, doc_id="id", text="body")``."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def one_per_id(rows: DataFrame) -> DataFrame:
    """Of the rows (doc_id, text, ...) that repeat an id, the one whose text has the least hash."""
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def texts_of(column: pa.Array, rows: int = 200) -> Iterator[str | None]:
    """The column's texts; only ``rows`` of them are Python strings at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


_held: dict = {}


def held(key, make: Callable):
    """What ``make`` gives, kept by the Python worker from task to task.

    A worker serves one stage after another, so it holds the memory of one key only.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Tasks that keep nothing do not run on top of what an earlier stage kept."""
    _held.clear()


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
