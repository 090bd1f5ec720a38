"""Long panels to wide ones and back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_wide(
    df: DataFrame,
    key: str,
    period: str,
    values: Sequence[str],
    periods: Sequence[int],
    flags: bool = True,
) -> DataFrame:
    """One row per key, columns ``value_period`` and presence flags ``in_period``.

    A conditional aggregate: one shuffle, and the periods are known to the
    plan. Two rows of one (key, period) raise while the query runs. A flag is 1
    if any value of that period is present.
    """
    cols = []
    for p in periods:
        here = F.col(period) == p
        for v in values:
            cols.append(F.max(F.when(here, F.col(v))).alias(f"{v}_{p}"))
        cols.append(F.count_if(here).alias(f"_rows_{p}"))
    wide = df.filter(F.col(period).isin(list(periods))).groupBy(key).agg(*cols)
    # the guard is a filter, so the key stays the plain column the rows are partitioned by
    most = F.greatest(*[F.col(f"_rows_{p}") for p in periods], F.lit(0))
    where = F.concat(F.lit(f"more than one row per ({key}, {period}), {key} = "), F.col(key).cast("string"))
    wide = wide.filter(F.when(most > 1, F.raise_error(where).cast("boolean")).otherwise(F.lit(True)))
    wide = wide.drop(*[f"_rows_{p}" for p in periods])
    return presence_flags(wide, values, periods) if flags else wide


def presence_flags(df: DataFrame, values: Sequence[str], periods: Sequence[int]) -> DataFrame:
    """0/1 columns ``in_period``: any of the period's values is present."""

    def any_present(p: int) -> Column:
        present = reduce(lambda x, y: x | y, [F.col(f"{v}_{p}").isNotNull() for v in values])
        return present.cast("int")

    return df.withColumns({f"in_{p}": any_present(p) for p in periods})


def to_long(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "stat", value: str = "value"
) -> DataFrame:
    """Wide to long: one row per key and column."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(keys), list(cols), name, value
    )
