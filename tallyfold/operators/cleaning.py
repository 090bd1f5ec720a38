"""Missing and infinite values, and row filters on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import finite_or_null, is_infinite, is_usable


def floating_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def inf_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Infinities and NaN become NULL in every floating-point column (or in ``cols``)."""
    cols = floating_columns(df) if cols is None else list(cols)
    return df.withColumns({c: finite_or_null(c) for c in cols}) if cols else df


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any missing value (NULL or NaN)."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def finite_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows whose listed columns are all present and finite."""
    return df.filter(reduce(lambda a, b: a & b, [is_usable(c) for c in cols]))


def impute(df: DataFrame, rules: Mapping[str, tuple]) -> DataFrame:
    """Per column: (value for an infinity, value for a missing one).

    The value for an infinity may be ``"max"``: the largest finite value of
    that column. All of these come from one aggregate over ``df``, beside the
    rows themselves, so pass a checkpointed table if it is expensive.
    """
    out = {}
    from_data = [c for c, (cap, _) in rules.items() if cap == "max"]
    caps = df.agg(F.struct(*[F.max(finite_or_null(c)).alias(c) for c in from_data])).scalar() if from_data else None
    for c, (cap, missing) in rules.items():
        largest = caps.getField(c) if cap == "max" else F.lit(float(cap))
        out[c] = (
            F.when(is_infinite(c), largest)
            .when(F.col(c).isNull() | F.isnan(c), F.lit(float(missing)))
            .otherwise(F.col(c))
        )
    return df.withColumns(out)


def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing and infinite become 0."""
    return df.withColumns({c: F.coalesce(finite_or_null(F.col(c).cast("double")), F.lit(0.0)) for c in cols})


def time_split(df: DataFrame, period: str, train: Sequence[int], test: Sequence[int]):
    """Rows of the training periods and rows of the test periods.

    ``period`` compared with literals reaches the scan, and prunes folders
    where the table is partitioned by it.
    """
    return df.filter(F.col(period).isin(list(train))), df.filter(F.col(period).isin(list(test)))
