"""Choosing, naming and adding columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def add_suffix(df: DataFrame, cols: Sequence[str], suffix: str) -> DataFrame:
    return rename(df, {c: c + suffix for c in cols})


def strip_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return rename(df, {c: c.removesuffix(suffix) for c in df.columns if c.endswith(suffix)})


def columns_like(df: DataFrame, text: str) -> list[str]:
    """Names that contain ``text``."""
    return [c for c in df.columns if text in c]


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    """Names in which the regular expression finds a match."""
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.search(c)]


def keep_suffix(df: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """The keys and every column whose name ends in ``suffix``."""
    return df.select(*keys, *[c for c in df.columns if c.endswith(suffix) and c not in keys])


def drop_first(df: DataFrame) -> DataFrame:
    return df.drop(df.columns[0])


def with_const(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def horizontal_sum(cols: Sequence[str]):
    """Sum across columns of one row; missing if any part is missing."""
    total = F.col(cols[0])
    for c in cols[1:]:
        total = total + F.col(c)
    return total


def features_and_label(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = ()):
    """Keys, features and the target under one name each; nothing else."""
    return df.select(*keys, *features, F.col(label).cast("double").alias("label"))
