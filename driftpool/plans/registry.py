"""Registry of named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name, with its SQL if it has one."""
    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places; both engines sum in their own order."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def round_array(column: str) -> Column:
    return F.transform(column, lambda x: F.round(x, 6))
