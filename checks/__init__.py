"""Queries over the given tables with the SQL each must agree with."""

from checks import aggregates, joins, statistics, tables, windows, workflows  # noqa: F401  (each registers its queries)
from checks.registry import QUERIES as ALL_QUERIES
from checks.registry import SQL as ALL_SQL

__all__ = ["ALL_QUERIES", "ALL_SQL"]
