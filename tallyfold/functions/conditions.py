"""Predicates and conditional counts with a stated rule for missing values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col


def is_in(c: Column | str, values: Iterable) -> Column:
    """Membership that is FALSE, not NULL, for a missing value."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def count_where(cond: Column, strict_null: bool = False) -> Column:
    """Aggregate: rows where ``cond`` holds.

    A missing condition does not count. With ``strict_null`` one missing
    condition makes the count of its group missing.
    """
    n = F.count_if(cond)
    if strict_null:
        return F.when(F.count(cond) == F.count(F.lit(1)), n)
    return n


def null_if_in(c: Column | str, codes: Iterable) -> Column:
    """Blank out the listed codes."""
    return F.when(~col(c).isin(list(codes)), col(c))


def blank_to_null(c: Column | str) -> Column:
    """The empty string means missing."""
    return F.nullif(col(c), F.lit(""))


def longer_than(c: Column | str, n: int) -> Column:
    """String-length predicate; a missing string fails it."""
    return F.coalesce(F.length(col(c)) > n, F.lit(False))
