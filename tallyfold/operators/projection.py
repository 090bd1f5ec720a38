"""Next-period projection from a wide panel, and the back-test of its weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import keep_suffix, strip_suffix
from .joins import inner_suffix
from .metrics import best_per_group
from .reshape import pivot_wide

#: (weights of three seasons, weights of two seasons)
Weights = tuple[tuple[float, float, float], tuple[float, float]]


def history_class(periods: Sequence[int]) -> Column:
    """1 present in all three periods, 2 in the last two, 3 in the last, 4 otherwise."""
    first, middle, last = [F.col(f"in_{p}") for p in periods]
    return (
        F.when((first == 1) & (middle == 1) & (last == 1), 1)
        .when((first == 0) & (middle == 1) & (last == 1), 2)
        .when((first == 0) & (middle == 0) & (last == 1), 3)
        .otherwise(4)
    )


def blend(stat: str, periods: Sequence[int], weights: Weights, class_col: str = "history") -> Column:
    """Weighted mix of the seasons a history has; else the last season as it is."""
    a, b, c = [F.col(f"{stat}_{p}") for p in periods]
    (w1, w2, w3), (v1, v2) = weights
    return (
        F.when(F.col(class_col) == 1, w1 * a + w2 * b + w3 * c)
        .when(F.col(class_col) == 2, v1 * b + v2 * c)
        .otherwise(c.cast("double"))
    )


def project_next(
    df: DataFrame, key: str, period: str, weights: Mapping[str, Weights], periods: Sequence[int]
) -> DataFrame:
    """Each key's statistics projected to the period after the last one.

    A key absent from the last period gets NULL.
    """
    target = periods[-1] + 1
    wide = pivot_wide(df, key, period, list(weights), periods).withColumn("history", history_class(periods))
    wide = wide.withColumns({f"{s}_{target}": blend(s, periods, w) for s, w in weights.items()})
    return strip_suffix(keep_suffix(wide, [key], f"_{target}"), f"_{target}")


def predict_from_two(stat: str, periods: Sequence[int], w_prev: float, w_last: float) -> Column:
    """Mix of two seasons where both are present; else the later one."""
    a, b = [F.col(f"{stat}_{p}") for p in periods]
    both = (F.col(f"in_{periods[0]}") == 1) & (F.col(f"in_{periods[1]}") == 1)
    return F.when(both, w_prev * a + w_last * b).otherwise(b.cast("double"))


def predicted_vs_actual(
    df: DataFrame,
    key: str,
    period: str,
    stats: Sequence[str],
    train: Sequence[int],
    test: int,
    w_prev: float,
    w_last: float,
) -> DataFrame:
    """Projected and actual statistics of the test period side by side."""
    wide = pivot_wide(df, key, period, stats, train)
    pred = wide.select(key, *[predict_from_two(s, train, w_prev, w_last).alias(s) for s in stats])
    actual = df.filter(F.col(period) == test).select(key, *stats)
    return inner_suffix(pred, actual, [key])


def weight_moments(
    df: DataFrame, key: str, period: str, stats: Sequence[str], train: Sequence[int], test: int
) -> DataFrame:
    """All that the error of any weight pair depends on: one row of sums per statistic.

    With p, l, y the earlier, later and actual value, over the keys that have all
    three: the second moments of p - y, l - y and y (small numbers first, so
    little cancels), and ``n``. Keys without the earlier season are predicted
    by l whatever the weights: ``rest`` sums their squared errors, ``n_rest`` counts
    them. One pass; a key's row becomes one row per statistic, and the panel is
    not joined to itself.
    """
    a, b = train
    wide = pivot_wide(df, key, period, stats, [*train, test])
    tested = wide.filter((F.col(f"in_{test}") == 1) & ((F.col(f"in_{a}") == 1) | (F.col(f"in_{b}") == 1)))
    both = (F.col(f"in_{a}") == 1) & (F.col(f"in_{b}") == 1)
    per_stat = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("stat"),
                    (F.col(f"{s}_{a}").cast("double") - F.col(f"{s}_{test}")).alias("p"),
                    (F.col(f"{s}_{b}").cast("double") - F.col(f"{s}_{test}")).alias("l"),
                    F.col(f"{s}_{test}").cast("double").alias("y"),
                )
                for s in stats
            ]
        )
    )
    long = tested.select(both.alias("both"), per_stat.alias("x")).select("both", "x.*")
    mixed = F.col("both") & F.col("p").isNotNull() & F.col("l").isNotNull()
    alone = ~F.col("both") & F.col("l").isNotNull()
    total = lambda value, where: F.coalesce(F.sum(F.when(where, value)), F.lit(0.0))
    p, l, y = F.col("p"), F.col("l"), F.col("y")
    products = {"pp": p * p, "ll": l * l, "yy": y * y, "pl": p * l, "py": p * y, "ly": l * y}
    return long.groupBy("stat").agg(
        F.count_if(mixed).alias("n"),
        *[total(value, mixed).alias(name) for name, value in products.items()],
        F.count_if(alone).alias("n_rest"),
        total(l * l, alone).alias("rest"),
    )


def _rmse_of(w_prev: Column, w_last: Column) -> Column:
    """The error of a weight pair from its statistic's moments: a quadratic form."""
    m = {k: F.col(k) for k in ("pp", "ll", "yy", "pl", "py", "ly")}
    excess = w_prev + w_last - 1
    squares = w_prev * w_prev * m["pp"] + w_last * w_last * m["ll"] + excess * excess * m["yy"]
    mixed = w_prev * w_last * m["pl"] + w_prev * excess * m["py"] + w_last * excess * m["ly"]
    total = F.greatest(squares + 2 * mixed, F.lit(0.0)) + F.col("rest")
    error = F.sqrt(F.try_divide(total, F.col("n") + F.col("n_rest")))
    return F.when(w_prev.isNotNull() & w_last.isNotNull(), error)


def backtest_weights(
    df: DataFrame,
    key: str,
    period: str,
    stats: Sequence[str],
    train: Sequence[int],
    test: int,
    grid: Sequence[tuple[float, float]],
) -> DataFrame:
    """RMSE of every weight pair for every statistic: (stat, w_prev, w_last, rmse).

    The grid meets one row of moments per statistic, so the work on the panel
    does not depend on its size.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(float(w1)).alias("w_prev"), F.lit(float(w2)).alias("w_last")) for w1, w2 in grid]))
    tried = weight_moments(df, key, period, stats, train, test).withColumn("_w", pairs).select("*", "_w.*")
    return tried.select("stat", "w_prev", "w_last", _rmse_of(F.col("w_prev"), F.col("w_last")).alias("rmse"))


def optimal_weights(
    df: DataFrame,
    key: str,
    period: str,
    stats: Sequence[str],
    train: Sequence[int],
    test: int,
    sum_to_one: bool = False,
) -> DataFrame:
    """The real-valued weight pair of least error per statistic: (stat, w_prev, w_last, rmse).

    The least squares of two unknowns, or of one if the weights must add up to 1.
    NULL where the seasons do not determine them (no key has both, or one
    season is a multiple of the other).
    """
    m = {k: F.col(k) for k in ("pp", "ll", "yy", "pl", "py", "ly")}
    moments = weight_moments(df, key, period, stats, train, test)
    if sum_to_one:
        apart = m["pp"] + m["ll"] - 2 * m["pl"]
        w_prev = F.try_divide(m["ll"] - m["pl"], F.when(apart > 1e-12 * (m["pp"] + m["ll"]), apart))
        w_last = 1 - w_prev
    else:
        pp, ll = m["pp"] + 2 * m["py"] + m["yy"], m["ll"] + 2 * m["ly"] + m["yy"]
        pl, py, ly = m["pl"] + m["py"] + m["ly"] + m["yy"], m["py"] + m["yy"], m["ly"] + m["yy"]
        det = pp * ll - pl * pl
        det = F.when(det > 1e-12 * pp * ll, det)
        w_prev, w_last = F.try_divide(py * ll - ly * pl, det), F.try_divide(ly * pp - py * pl, det)
    solved = moments.withColumns({"w_prev": w_prev, "w_last": w_last})
    return solved.select("stat", "w_prev", "w_last", _rmse_of(F.col("w_prev"), F.col("w_last")).alias("rmse"))


def best_weights(metrics: DataFrame) -> DataFrame:
    """Per statistic the weight pair with the smallest error."""
    return best_per_group(metrics, ["stat"], "rmse", ["w_prev"])
