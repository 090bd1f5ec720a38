"""Where queries and their checking SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyfold.operators.windows import ROWS

#: session setting: cut groups beyond so many rows
WINDOW_ROWS = "spark.tallyfold.windowRows"

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def window_rows(spark: SparkSession) -> int:
    """Rows of one user, order or table that a task may hold in a window."""
    return int(spark.conf.get(WINDOW_ROWS, str(ROWS)))


def game_rows(spark: SparkSession) -> int | None:
    """The same for games, which are small by nature: not cut unless the session asks for it."""
    asked = spark.conf.get(WINDOW_ROWS, None)
    return int(asked) if asked else None


def window_buckets(spark: SparkSession) -> int:
    """Files of a table stored by key: as many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with the SQL it must equal."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add
