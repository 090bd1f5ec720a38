"""Group aggregates.

Every operator here is a ``groupBy().agg()`` of mergeable aggregates, so Spark
combines rows before each shuffle: a key that holds a large share of the rows
sends one partial row per input task, not its rows. For the same reason the
two-level rollups are two such steps rather than a repartition on the outer
key, which would bring all rows of a frequent key to one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import count_where, ratio
from .joins import union_all


def distinct_count(c: str, count_missing: bool = False) -> Column:
    """Aggregate: exact distinct values, optionally with missing as a value."""
    n = F.count_distinct(F.col(c))
    if count_missing:
        n = n + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))
    return n


def agg_then_derive(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Mapping[str, Column],
    *derive: Mapping[str, Column],
) -> DataFrame:
    """Aggregate, then derive columns from the aggregates in stages.

    A stage sees the results of the stages before it, never the source
    columns, so a derived name can safely equal a source name.
    """
    out = df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggs.items()])
    for stage in derive:
        out = out.withColumns(dict(stage))
    return out


def gather(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring the rows of a key together ahead of a wide aggregate of many small groups.

    Where a group's few rows lie in as many tasks, each task would hold, and send,
    one partial row per row, wider than the row itself. Gathered rows combine into
    one partial row per group. Adaptive execution splits a key that fills
    several tasks, whose partial rows the aggregate merges.
    """
    return df.hint("rebalance", *keys)


def counts_by_code(
    df: DataFrame, keys: Sequence[str], code: str, names: Mapping[object, str]
) -> DataFrame:
    """One counter column per code value, in one aggregate (no pivot)."""
    return df.groupBy(*keys).agg(
        *[count_where(F.col(code) == value).alias(name) for value, name in names.items()]
    )


def shares(df: DataFrame, cols: Sequence[str], total: str, suffix: str = "_per") -> DataFrame:
    """Each column as a percentage of ``total``."""
    return df.withColumns({c + suffix: ratio(c, total) * 100 for c in cols})


def weighted_position(share_cols: Sequence[str]) -> Column:
    """Mean position from the percentages at positions 1, 2, 3, ..."""
    total = F.lit(0.0)
    for position, c in enumerate(share_cols, start=1):
        total = total + position * F.col(c)
    return total / 100


def two_level(
    df: DataFrame,
    outer: Sequence[str],
    inner: Sequence[str],
    inner_aggs: Mapping[str, Column],
    outer_aggs: Mapping[str, Column],
) -> DataFrame:
    """Aggregate per (outer, inner), then those results per outer key."""
    first = df.groupBy(*outer, *inner).agg(*[c.alias(n) for n, c in inner_aggs.items()])
    return first.groupBy(*outer).agg(*[c.alias(n) for n, c in outer_aggs.items()])


def rollup_max_sum(
    df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str, name: str
) -> DataFrame:
    """Largest value per (outer, inner), summed per outer key."""
    return two_level(df, outer, inner, {name: F.max(value)}, {name: F.sum(name)})


def mean_of_means(
    df: DataFrame,
    outer: Sequence[str],
    inner: Sequence[str],
    mean_cols: Sequence[str] = (),
    sum_cols: Sequence[str] = (),
) -> DataFrame:
    """Mean per (outer, inner), then the unweighted mean of those per outer key.

    Not the pooled mean: a short inner group weighs as much as a long one.
    ``sum_cols`` are summed at both levels.
    """
    return two_level(
        df,
        outer,
        inner,
        {**{c: F.avg(c) for c in mean_cols}, **{c: F.sum(c) for c in sum_cols}},
        {**{c: F.avg(c) for c in mean_cols}, **{c: F.sum(c) for c in sum_cols}},
    )


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def dedupe_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row per key in a stated order.

    Spark keeps only each task's first row per key before the shuffle
    (``WindowGroupLimit``), so many rows of one key cost no more than few.
    """
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def group_sizes(df: DataFrame, cols: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def stack_sum(dfs: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Stack tables and sum ``value`` per key: one number per key of any table."""
    return union_all(*[d.select(key, value) for d in dfs]).groupBy(key).agg(F.sum(value).alias(value))
