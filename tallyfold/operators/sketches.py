"""Distinct counts that can be stored and merged: HyperLogLog sketches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: registers of a sketch as a power of two
PRECISION = 12


def distinct_sketches(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], precision: int = PRECISION) -> DataFrame:
    """Per key one sketch of each column's distinct values: new name -> column. Missing values do not count.

    A sketch has at most 2 ** precision bytes or so, however many rows it has
    seen; tasks build their own and merge them. Whole numbers, strings and
    binary columns.
    """
    return df.groupBy(*keys).agg(*[F.hll_sketch_agg(c, F.lit(precision)).alias(n) for n, c in columns.items()])


def merged(sketches: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The sketches of a coarser level, from those of a finer one; no key is the whole."""
    return sketches.groupBy(*keys).agg(*[F.hll_union_agg(n).alias(n) for n in names])


def estimates(sketches: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sketches replaced by their estimated distinct counts."""
    return sketches.withColumns({n: F.hll_sketch_estimate(n) for n in names})


def relative_error(precision: int = PRECISION, deviations: float = 3.0) -> float:
    """So many standard errors of a merged sketch's estimate, relative to the exact count."""
    return deviations * 1.04 / 2 ** (precision / 2)
