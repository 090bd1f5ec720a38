"""Joins on keys and stacking.

No join hints a broadcast of a table whose size is unknown: Spark broadcasts a
side by itself when its measured size is below
``spark.sql.autoBroadcastJoinThreshold``, and otherwise sort-merges with AQE
splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise if a key occurs twice. One aggregate with partial counts."""
    twice = duplicate_keys(df, keys).limit(1).collect()
    if twice:
        raise ValueError(f"key {list(keys)} is not unique, e.g. {twice[0].asDict()}")
    return df


def _one_per_key(df: DataFrame, keys: Sequence[str], null_safe: bool) -> DataFrame:
    """The rows of ``df``; a second row of a key raises while the query runs. Nothing runs before."""
    if not null_safe:  # a missing key matches nothing
        df = df.na.drop("any", subset=list(keys))
    others = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(F.lit(0).alias("_"), *others)).alias("_row"))
    shown = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    twice = F.concat(F.lit(f"more than one row with {', '.join(keys)} = "), shown)
    single = rows.filter(F.when(F.col("_n") > 1, F.raise_error(twice).cast("boolean")).otherwise(F.lit(True)))
    return single.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def left(
    a: DataFrame,
    b: DataFrame,
    on: Sequence[str] | None = None,
    left_on: Sequence[str] | None = None,
    right_on: Sequence[str] | None = None,
    null_safe: bool = False,
    expect: str = "m:n",
) -> DataFrame:
    """Left equi-join that keeps the left key columns.

    ``null_safe`` lets a missing key match a missing key. ``expect="m:1"``
    raises while the query runs if the right side has two rows for a key that
    can match; ``"m:n"`` allows a fan-out.
    """
    left_on = list(on if on is not None else left_on)
    right_on = list(on if on is not None else right_on)
    if expect == "m:1":
        b = _one_per_key(b, right_on, null_safe)
    elif expect != "m:n":
        raise ValueError(f"expect must be 'm:1' or 'm:n', not {expect!r}")
    clash = sorted((set(b.columns) - set(right_on)) & set(a.columns))
    if clash:
        raise ValueError(f"both sides have {clash}; rename one side first")
    hidden = {k: f"_right_{i}" for i, k in enumerate(right_on)}
    b = b.withColumnsRenamed(hidden)
    pairs = [
        F.col(l).eqNullSafe(F.col(hidden[r])) if null_safe else F.col(l) == F.col(hidden[r])
        for l, r in zip(left_on, right_on, strict=True)
    ]
    return a.join(b, reduce(lambda x, y: x & y, pairs), "left").drop(*hidden.values())


def role_join(fact: DataFrame, dim: DataFrame, key: str, roles: Mapping[str, str]) -> DataFrame:
    """Join one dimension once per role.

    ``roles`` maps a fact column to the suffix its copy of the dimension's
    columns gets.
    """
    values = [c for c in dim.columns if c != key]
    for fact_key, suffix in roles.items():
        side = dim.select(F.col(key), *[F.col(c).alias(f"{c}{suffix}") for c in values])
        fact = left(fact, side, left_on=[fact_key], right_on=[key])
    return fact


def inner_suffix(
    a: DataFrame, b: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_pred", "_actual")
) -> DataFrame:
    """Inner join; columns both sides have get a suffix per side."""
    shared = [c for c in a.columns if c in b.columns and c not in on]
    a = a.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    b = b.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return a.join(b, list(on), "inner")


def roster_complete(
    roster: DataFrame, preds: DataFrame, key: str, value: str, default: float = 0.0
) -> DataFrame:
    """Every roster row with its prediction, or ``default`` where there is none."""
    joined = left(roster.select(key), preds.select(key, value), on=[key])
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def union_all(*dfs: DataFrame) -> DataFrame:
    """Stack by column name, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), dfs)
