import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import (
    blank_to_null,
    completed_years,
    count_where,
    cycle_position,
    finite_or_null,
    is_in,
    longer_than,
    null_if_in,
    ratio,
    remap,
    round_to,
)


def one(spark, schema, rows, **cols):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_ratio_modes(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (3.0, 2.0), (1.0, None), (math.nan, 0.0)]
    got = one(spark, "a double, b double", rows, n=ratio("a", "b"), i=ratio("a", "b", "ieee"))
    assert [r["n"] for r in got][:6] == [None, None, None, None, 1.5, None]
    ieee = [r["i"] for r in got]
    assert ieee[0] == math.inf and ieee[1] == -math.inf and math.isnan(ieee[2]) and math.isnan(ieee[6])
    assert ieee[3] is None and ieee[4] == 1.5 and ieee[5] is None
    with pytest.raises(ValueError):
        ratio("a", "b", "other")


def test_rounding(spark):
    got = one(spark, "x double", [(0.0625,), (0.3125,), (2.5,)], e=round_to("x"), u=round_to("x", 3, "half_up"), z=round_to("x", 0))
    assert [r["e"] for r in got] == [0.062, 0.312, 2.5]
    assert [r["u"] for r in got] == [0.063, 0.313, 2.5]
    assert got[2]["z"] == 2.0


def test_completed_years(spark):
    d = dt.date
    births = [(d(1990, 4, 1),), (d(1990, 4, 2),), (d(1992, 2, 29),), (None,)]
    got = one(spark, "b date", births, a=completed_years("b", F.lit("2021-04-01")), leap=completed_years("b", F.lit("2021-02-28")))
    assert [r["a"] for r in got] == [31, 30, 29, None]
    assert got[2]["leap"] == 28  # the 29th has not come yet


def test_codes_and_missing(spark):
    rows = [("a",), ("b",), ("",), (None,)]
    got = one(spark, "x string", rows, i=is_in("x", ["a"]), n=null_if_in("x", ["a"]), b=blank_to_null("x"), l=longer_than("x", 0))
    assert [r["i"] for r in got] == [True, False, False, False]
    assert [r["n"] for r in got] == [None, "b", "", None]
    assert [r["b"] for r in got] == ["a", "b", None, None]
    assert [r["l"] for r in got] == [True, True, False, False]


def test_count_where(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (2, "b")], "k int, x string")
    got = df.groupBy("k").agg(count_where(F.col("x") == "a").alias("n"), count_where(F.col("x") == "a", True).alias("s")).orderBy("k")
    assert [tuple(r) for r in got.collect()] == [(1, 1, None), (2, 1, 1)]


def test_cycle_remap_finite(spark):
    got = one(spark, "r int", [(1,), (9,), (10,), (18,), (19,)], p=cycle_position("r", 9), m=remap("r", {1: 100}))
    assert [r["p"] for r in got] == [1, 9, 1, 9, 1]
    assert [r["m"] for r in got] == [100, 9, 10, 18, 19]
    got = one(spark, "x double", [(1.0,), (math.inf,), (-math.inf,), (math.nan,), (None,)], f=finite_or_null("x"))
    assert [r["f"] for r in got] == [1.0, None, None, None, None]
