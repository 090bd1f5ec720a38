"""Error measures and feature screening."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from .reshape import to_long
from .windows import ROWS, ordered_scan


def rmse(actual: Column | str, predicted: Column | str) -> Column:
    """Aggregate: root mean squared error over rows where both are present."""
    a = F.col(actual) if isinstance(actual, str) else actual
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    return F.sqrt(F.avg((p - a) * (p - a)))


def rmse_per_stat(
    df: DataFrame, stats: Sequence[str], suffixes: tuple[str, str] = ("_pred", "_actual")
) -> DataFrame:
    """(stat, rmse) for pairs of columns ``stat_pred`` and ``stat_actual``."""
    row = df.agg(*[rmse(F.col(s + suffixes[1]), F.col(s + suffixes[0])).alias(s) for s in stats])
    return to_long(row, [], stats, "stat", "rmse")


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", eps: float = 0.0, by: Sequence[str] = ()
) -> DataFrame:
    """RMSE, MAE and MAPE in percent.

    ``eps`` is added to the denominator of MAPE; rows with a zero denominator
    do not count towards it.
    """
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        rmse(y, p).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
        (F.avg(F.abs(ratio(y - p, y + eps))) * 100).alias("mape"),
    )


_PAIR = "a int, b int, n double, sa double, sb double, saa double, sbb double, sab double"


def _pair_sums(batches):
    """Per task one row per pair of columns: sums over the rows that have both. Nulls and NaN are missing."""
    total = None
    for batch in batches:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64)
        there = ~np.isnan(x)
        x, there = np.where(there, x, 0.0), there.astype(np.float64)
        sums, squares = x.T @ there, (x * x).T @ there
        part = np.stack([there.T @ there, sums, sums.T, squares, squares.T, x.T @ x])
        total = part if total is None else total + part
    if total is not None:
        a, b = np.triu_indices(total.shape[1], 1)
        columns = [pa.array(i.astype(np.int32)) for i in (a, b)] + [pa.array(t[a, b]) for t in total]
        yield pa.record_batch(columns, names=["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])


def corr_pairs(
    df: DataFrame, cols: Sequence[str], method: str = "pearson", key: Sequence[str] = (), rows: int | None = ROWS
) -> DataFrame:
    """(feature_a, feature_b, corr) for every pair of columns.

    Every task adds up one moment matrix of its rows, less the columns' means, and
    the matrices are summed: the plan does not grow with the number of pairs. A
    pair counts the rows that have both values (NaN is missing); with fewer
    than two, or a constant side, its correlation is NULL. ``method="spearman"``
    correlates ``average_ranks``, for which ``key`` must name a unique key.
    """
    cols = list(cols)
    if method == "spearman":
        df = average_ranks(df, key, cols, rows)
    elif method != "pearson":
        raise ValueError(f"method must be 'pearson' or 'spearman', not {method!r}")
    number = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"_{i}") for i, c in enumerate(cols)]
    values = df.select(*number)
    means = values.agg(F.struct(*[F.avg(c).alias(c) for c in values.columns])).scalar()
    centred = values.select(*[(F.col(c) - means.getField(c)).alias(c) for c in values.columns])
    sums = centred.mapInArrow(_pair_sums, _PAIR).groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]
    )
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    spread = (n * F.col("saa") - sa * sa) * (n * F.col("sbb") - sb * sb)
    # what rounding leaves of a constant column's spread is none
    spread = F.when((n > 1) & (spread > 1e-24 * n * n * F.col("saa") * n * F.col("sbb")), spread)
    corr = F.try_divide(n * F.col("sab") - sa * sb, F.sqrt(spread))
    names = F.array(*[F.lit(c) for c in cols])
    return sums.select(names[F.col("a")].alias("feature_a"), names[F.col("b")].alias("feature_b"), corr.alias("corr"))


def average_ranks(df: DataFrame, key: Sequence[str], cols: Sequence[str], rows: int | None = ROWS) -> DataFrame:
    """Each column's values replaced by their ranks in the whole column, ties sharing their mean rank.

    ``key`` must be unique. Values are counted first, so a frequent value is one
    row of the scan, and a column is cut where it has many values (``rows``, see
    ``windows``). Missing values and NaN have no rank.
    """
    if not key:
        raise ValueError("ranks need a unique key")
    numbers = df.select(*key, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    long = to_long(numbers, key, cols, "_feature", "_value").filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
    counts = long.groupBy("_feature", "_value").agg(F.count(F.lit(1)).alias("_n"))
    before = ordered_scan(counts, ["_feature"], ["_value"], sum_before={"_before": "_n"}, rows=rows)
    ranks = before.select("_feature", "_value", (F.col("_before") + (F.col("_n") + 1) / 2).alias("_rank"))
    ranked = long.join(ranks, ["_feature", "_value"])
    return ranked.groupBy(*key).agg(*[F.max(F.when(F.col("_feature") == c, F.col("_rank"))).alias(c) for c in cols])


def best_per_group(df: DataFrame, group: Sequence[str], metric: str, ties: Sequence[str]) -> DataFrame:
    """The row with the smallest metric per group, ``ties`` deciding equal ones."""
    w = Window.partitionBy(*group).orderBy(metric, *ties)
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")
