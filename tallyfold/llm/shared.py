"""Helpers that several text operators use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: rows sent to Python at once
BATCH_ROWS = 256


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage and keeps expensive columns from being computed twice. The
    files outlive the executors that wrote them; they lie in a folder of their
    own under ``spark.checkpoint.dir``, which is the cluster's to clear.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, function: Callable, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` with batches small enough for rows that hold long texts.

    Lowers the session's limit of rows per Arrow batch, which both sides of the
    pipe hold several times over; it stays lowered, as plans run later.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df.mapInArrow(function, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Inside higher-order functions a plain column expression is evaluated anew
    for every element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
