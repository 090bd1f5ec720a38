"""Arithmetic with explicit rules for zero denominators, infinities and rounding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str, on_zero: str = "null") -> Column:
    """``num / den`` as double.

    ``on_zero="null"`` gives NULL for a zero denominator, ``"ieee"`` gives
    +Inf / -Inf / NaN. Missing input is NULL either way.
    """
    n, d = col(num).cast("double"), col(den).cast("double")
    quotient = F.try_divide(n, d)
    if on_zero == "null":
        return quotient
    if on_zero != "ieee":
        raise ValueError(f"on_zero must be 'null' or 'ieee', not {on_zero!r}")
    by_zero = (
        F.when(F.isnan(n) | (n == 0), F.lit(NAN))
        .when(n > 0, F.lit(INF))
        .when(n < 0, F.lit(-INF))
    )
    return F.when(d == 0, by_zero).otherwise(quotient)


def round_to(c: Column | str, digits: int = 3, mode: str = "half_even") -> Column:
    """Round a double half to even, or half away from zero.

    Half-even works on the scaled double itself, as statistics tools do, which
    also spares a decimal object per value.
    """
    if mode == "half_even":
        return F.rint(col(c) * F.lit(10.0**digits)) / F.lit(10.0**digits)
    if mode == "half_up":
        return F.round(col(c), digits)
    raise ValueError(f"mode must be 'half_even' or 'half_up', not {mode!r}")


def rate_per(num: Column | str, den: Column | str, n: float, on_zero: str = "null") -> Column:
    """Events per ``n`` units of ``den``."""
    return ratio(num, den, on_zero) * F.lit(float(n))


def weighted_sum(c: Column | str, weight: Column | str) -> Column:
    """Aggregate: sum of value times weight."""
    return F.sum(col(c) * col(weight))


def is_infinite(c: Column | str) -> Column:
    return F.coalesce(col(c).isin(INF, -INF), F.lit(False))


def is_usable(c: Column | str) -> Column:
    """Neither missing, nor NaN, nor infinite."""
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & ~is_infinite(x)


def finite_or_null(c: Column | str) -> Column:
    """NaN and both infinities become NULL."""
    x = col(c)
    return F.when(~F.isnan(x) & ~x.isin(INF, -INF), x)


def completed_years(birth: Column | str, on: Column | str) -> Column:
    """Whole years between two dates: the birthday itself already counts."""
    b, r = col(birth).cast("date"), col(on).cast("date")
    day_of = lambda d: F.month(d) * 100 + F.dayofmonth(d)
    before_birthday = (day_of(r) < day_of(b)).cast("int")
    return (F.year(r) - F.year(b) - before_birthday).cast("long")


def cycle_position(rank: Column | str, n: int) -> Column:
    """Place 1..n of a 1-based rank in a cycle of length ``n``."""
    return (col(rank) - 1) % n + 1


def remap(c: Column | str, mapping: Mapping) -> Column:
    """Replace the listed values, keep every other one (and NULL)."""
    x = col(c)
    out = None
    for old, new in mapping.items():
        out = F.when(x == old, F.lit(new)) if out is None else out.when(x == old, F.lit(new))
    return x if out is None else out.otherwise(x)
