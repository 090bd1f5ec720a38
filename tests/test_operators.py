import math
import random

import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from tallyfold.operators import aggregate as agg
from tallyfold.operators import cleaning, columns, joins, metrics, projection, reshape, sketches


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "k int, a_2024 double, b_2023 double")
    assert columns.keep_suffix(df, ["k"], "_2024").columns == ["k", "a_2024"]
    assert columns.strip_suffix(df, "_2024").columns == ["k", "a", "b_2023"]
    assert columns.add_suffix(df, ["k"], "_x").columns == ["k_x", "a_2024", "b_2023"]
    assert columns.columns_like(df, "_20") == ["a_2024", "b_2023"]
    assert columns.columns_matching(df, "_2023|^k$") == ["k", "b_2023"]
    assert columns.drop_first(df).columns == ["a_2024", "b_2023"]


def test_cleaning(spark):
    rows = [(1, 1.0, 2.0), (2, math.inf, 1.0), (3, math.nan, 1.0), (4, None, -math.inf), (5, 7.0, None)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    assert [r["k"] for r in as_dicts(cleaning.drop_incomplete(cleaning.inf_to_null(df)), "k")] == [1]
    assert [r["k"] for r in as_dicts(cleaning.drop_incomplete(df), "k")] == [1, 2]
    assert [r["k"] for r in as_dicts(cleaning.finite_rows(df, ["a"]), "k")] == [1, 5]
    fixed = as_dicts(cleaning.impute(df, {"a": (21, 0)}), "k")
    assert [r["a"] for r in fixed] == [1.0, 21.0, 0.0, 0.0, 7.0]
    capped = as_dicts(cleaning.impute(df, {"a": ("max", 0), "b": ("max", 9)}), "k")
    assert [r["a"] for r in capped] == [1.0, 7.0, 0.0, 0.0, 7.0]
    assert [r["b"] for r in capped] == [2.0, 1.0, 1.0, 2.0, 9.0]
    assert [r["a"] for r in as_dicts(cleaning.zero_fill(df, ["a"]), "k")] == [1.0, 0.0, 0.0, 0.0, 7.0]


def test_left_join_rules(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, c string")
    b = spark.createDataFrame([("x", 10), (None, 20), ("y", 30)], "c string, v int")
    assert [r["v"] for r in as_dicts(joins.left(a, b, on=["c"]), "k")] == [10, None]
    assert [r["v"] for r in as_dicts(joins.left(a, b, on=["c"], null_safe=True), "k")] == [10, 20]
    twice = joins.union_all(b, b)
    assert joins.left(a, twice, on=["c"]).count() == 3
    # the check is part of the query: nothing runs before it, and a missing key, which matches nothing, may repeat
    checked = joins.left(a, twice, on=["c"], expect="m:1")
    with pytest.raises(Exception, match="more than one row with c = x"):
        checked.collect()
    fine = joins.left(a, joins.union_all(b, b.filter("c IS NULL")), on=["c"], expect="m:1")
    assert fine.columns == ["k", "c", "v"] and [r["v"] for r in as_dicts(fine, "k")] == [10, None]
    with pytest.raises(Exception, match="more than one row with c = NULL"):
        joins.left(a, joins.union_all(b, b.filter("c IS NULL")), on=["c"], null_safe=True, expect="m:1").collect()
    with pytest.raises(ValueError, match="rename"):
        joins.left(a, b.withColumnRenamed("v", "k"), on=["c"])
    assert [r["n"] for r in as_dicts(joins.duplicate_keys(twice, ["c"]))] == [2, 2, 2]


def test_inner_suffix_and_roster(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, s double")
    b = spark.createDataFrame([(1, 7.0), (3, 8.0)], "k int, s double")
    assert as_dicts(joins.inner_suffix(a, b, ["k"])) == [{"k": 1, "s_pred": 5.0, "s_actual": 7.0}]
    roster = spark.createDataFrame([(1,), (2,), (9,), (9,)], "k int")
    full = joins.roster_complete(roster, agg.stack_sum([a, b], "k", "s"), "k", "s")
    assert [(r["k"], r["s"]) for r in as_dicts(full, "k")] == [(1, 12.0), (2, 6.0), (9, 0.0), (9, 0.0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_two_level(spark):
    rows = [("p", "g1", 1.0)] + [("p", "g2", 11.0)] * 9
    df = spark.createDataFrame(rows, "p string, g string, x double").withColumn("n", F.lit(1))
    got = as_dicts(agg.mean_of_means(df, ["p"], ["g"], ["x"], ["n"]))
    assert got == [{"p": "p", "x": 6.0, "n": 10}]  # the pooled mean is 10
    assert as_dicts(agg.rollup_max_sum(df, ["p"], ["g"], "x", "m")) == [{"p": "p", "m": 12.0}]


def test_positions(spark):
    spots = [1, 1, 2, 3, 3, 3]
    df = spark.createDataFrame([("a", s) for s in spots], "k string, s int")
    out = agg.counts_by_code(df, ["k"], "s", {1: "s1", 2: "s2", 3: "s3"}).withColumn("n", columns.horizontal_sum(["s1", "s2", "s3"]))
    out = agg.shares(out, ["s1", "s2", "s3"], "n")
    row = as_dicts(out.withColumn("mean", agg.weighted_position(["s1_per", "s2_per", "s3_per"])))[0]
    assert row["n"] == 6
    assert sum(row[f"s{i}_per"] for i in (1, 2, 3)) == pytest.approx(100)
    assert row["mean"] == pytest.approx(sum(spots) / 6)


def test_derived_name_may_shadow_a_source_column(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    out = agg.agg_then_derive(df, ["k"], {"v": F.sum("v")}, {"w": F.col("v") * 2}, {"z": F.col("w") + F.col("v")})
    assert as_dicts(out) == [{"k": "a", "v": 3, "w": 6, "z": 9}]


@pytest.mark.parametrize("parts", [1, 7])
def test_dedupe_is_independent_of_row_order(spark, parts):
    rows = [(k, o, f"{k}-{o}") for k in range(5) for o in range(10)]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, o int, v string").repartition(parts)
    first = agg.dedupe_first(df, ["k"], ["o"])
    # before and after the shuffle; a single partition needs none
    assert plan(first).count("WindowGroupLimit") == (2 if parts > 1 else 1)
    assert [r["v"] for r in as_dicts(first, "k")] == [f"{k}-0" for k in range(5)]


def test_pivot_and_flags(spark):
    df = spark.createDataFrame([(1, 2021, 5, None), (1, 2023, 7, 1), (2, 2022, None, None)], "k int, y int, a int, b int")
    got = as_dicts(reshape.pivot_wide(df, "k", "y", ["a", "b"], [2021, 2022, 2023]), "k")
    assert got[0] == {"k": 1, "a_2021": 5, "b_2021": None, "a_2022": None, "b_2022": None, "a_2023": 7, "b_2023": 1,
                      "in_2021": 1, "in_2022": 0, "in_2023": 1}
    assert got[1]["in_2022"] == 0  # a row without any value is no presence
    doubled = joins.union_all(df, df)
    with pytest.raises(Exception, match="more than one row"):
        reshape.pivot_wide(doubled, "k", "y", ["a"], [2021, 2022, 2023]).select("in_2021").collect()


def test_pivot_takes_one_shuffle(spark):
    df = spark.createDataFrame([(1, 2021, 5)], "k int, y int, a int")
    wide = reshape.pivot_wide(df, "k", "y", ["a"], [2021, 2022])
    joined = wide.join(wide.select("k", F.col("a_2021").alias("z")), "k")
    assert plan(wide).count("Exchange") == 1
    assert "raise_error" in plan(joined)


PATTERNS = {"111": 1, "011": 2, "001": 3, "101": 4, "110": 4, "100": 4, "010": 4}


def test_history_patterns(spark):
    years = (2021, 2022, 2023)
    rows = [(p, y, 10.0) for p in PATTERNS for y, here in zip(years, p) if here == "1"]
    df = spark.createDataFrame(rows, "k string, y int, s double")
    wide = reshape.pivot_wide(df, "k", "y", ["s"], years).withColumn("h", projection.history_class(years))
    assert {r["k"]: r["h"] for r in as_dicts(wide)} == PATTERNS
    out = projection.project_next(df, "k", "y", {"s": ((0.2, 0.3, 0.5), (0.4, 0.6))}, years)
    for r in as_dicts(out):  # a constant statistic stays, a missing last season gives none
        assert r["s"] == (pytest.approx(10.0) if r["k"][2] == "1" else None)


def test_blend_weights(spark):
    rows = [("a", 2021, 1.0), ("a", 2022, 2.0), ("a", 2023, 4.0), ("b", 2022, 2.0), ("b", 2023, 4.0)]
    df = spark.createDataFrame(rows, "k string, y int, s double")
    out = projection.project_next(df, "k", "y", {"s": ((0.1, 0.2, 0.7), (0.2, 0.8))}, (2021, 2022, 2023))
    assert [r["s"] for r in as_dicts(out, "k")] == [pytest.approx(3.3), pytest.approx(3.6)]


def test_backtest(spark):
    rows = [("a", 2021, 1.0), ("a", 2022, 3.0), ("a", 2023, 2.0), ("b", 2021, 5.0), ("b", 2023, 9.0), ("c", 2022, 4.0), ("c", 2023, 6.0)]
    df = spark.createDataFrame(rows, "k string, y int, s double")
    grid = [(0.5, 0.5), (0.0, 1.0)]
    got = as_dicts(projection.backtest_weights(df, "k", "y", ["s"], (2021, 2022), 2023, grid), "w_prev")
    # b has no second season: no prediction, and no part in the error
    assert got[0]["rmse"] == pytest.approx(math.sqrt(((3 - 2) ** 2 + (4 - 6) ** 2) / 2))
    assert got[1]["rmse"] == pytest.approx(math.sqrt(((2 - 2) ** 2 + (4 - 6) ** 2) / 2))
    best = as_dicts(projection.best_weights(projection.backtest_weights(df, "k", "y", ["s"], (2021, 2022), 2023, grid)))
    assert (best[0]["w_prev"], best[0]["w_last"]) == (0.5, 0.5)


def test_metrics(spark):
    df = spark.createDataFrame([(2.0, 3.0), (4.0, 2.0), (0.0, 1.0)], "label double, prediction double")
    row = as_dicts(metrics.regression_metrics(df))[0]
    assert row["rmse"] == pytest.approx(math.sqrt(2)) and row["mae"] == pytest.approx(4 / 3)
    assert row["mape"] == pytest.approx(50.0)
    pairs = as_dicts(metrics.corr_pairs(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0)], "a double, b double"), ["a", "b"]))
    assert pairs[0]["feature_a"] == "a" and pairs[0]["corr"] == pytest.approx(0.9933992678)


def test_moments_give_what_the_rows_give(spark):
    rng = random.Random(9)
    rows = []
    for k in range(200):
        for y in (2021, 2022, 2023):
            if rng.random() < 0.8:
                rows.append((k, y, rng.choice([None, rng.uniform(0, 9)]) if k % 7 == 0 else rng.uniform(0, 9) + 1000, float(k % 5)))
    df = spark.createDataFrame(rows, "k int, y int, a double, b double")
    grid = [(0.3, 0.7), (1.0, 0.0), (0.5, 0.9)]
    got = {(r["stat"], r["w_prev"], r["w_last"]): r["rmse"] for r in projection.backtest_weights(df, "k", "y", ["a", "b"], (2021, 2022), 2023, grid).collect()}
    value = {(k, y): {"a": a, "b": b} for k, y, a, b in rows}

    def error(stat, w1, w2):
        errors = []
        for k in range(200):
            p, l, t = (value.get((k, y)) for y in (2021, 2022, 2023))
            there = [v is not None and any(x is not None for x in v.values()) for v in (p, l, t)]
            if not there[2] or not (there[0] or there[1]):
                continue
            guess = l and l[stat]
            if there[0] and there[1]:
                guess = None if None in (p[stat], l[stat]) else w1 * p[stat] + w2 * l[stat]
            if guess is not None and t[stat] is not None:
                errors.append((guess - t[stat]) ** 2)
        return (sum(errors) / len(errors)) ** 0.5

    for (stat, w1, w2), rmse in got.items():
        assert rmse == pytest.approx(error(stat, w1, w2), rel=1e-9)
    for one in (False, True):
        best = {r["stat"]: r for r in projection.optimal_weights(df, "k", "y", ["a", "b"], (2021, 2022), 2023, one).collect()}
        # b never changes: no pair is better than another along a line, or every pair that adds up to 1
        assert best["b"]["w_prev"] is None and best["b"]["rmse"] is None
        w1, w2, rmse = best["a"]["w_prev"], best["a"]["w_last"], best["a"]["rmse"]
        assert rmse == pytest.approx(error("a", w1, w2), rel=1e-7) and (not one or w1 + w2 == pytest.approx(1))
        for d in (-0.01, 0.01):
            assert rmse < error("a", w1 + d, w2 - d) and (one or rmse < error("a", w1 + d, w2))


def test_correlations_of_incomplete_columns(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, float("nan"), rng.gauss(0, 1), 3.0]), rng.randrange(5) * 1.0, 1e9 + rng.random(), 7.0) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double").repartition(5)
    ok = lambda v: v is not None and v == v

    def plain(x, y):
        n = len(x)
        mx, my = sum(x) / n, sum(y) / n
        return sum((a - mx) * (b - my) for a, b in zip(x, y)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5

    columns_ = {n: [r[i] for r in rows] for i, n in enumerate("kabcd")}

    def ranked(values):
        have = sorted(v for v in values if ok(v))
        return [None if not ok(v) else (2 * have.index(v) + have.count(v) + 1) / 2 for v in values]

    for method, data in (("pearson", columns_), ("spearman", {n: ranked(v) for n, v in columns_.items()})):
        got = {(r[0], r[1]): r[2] for r in metrics.corr_pairs(df, ["a", "b", "c", "d"], method, ["k"], rows=60).collect()}
        assert len(got) == 6
        for (x, y), corr in got.items():
            if "d" in (x, y):
                assert corr is None
            else:
                both = [(p, q) for p, q in zip(data[x], data[y]) if ok(p) and ok(q)]
                assert corr == pytest.approx(plain(*zip(*both)), rel=1e-6)
    assert metrics.corr_pairs(df.limit(0), ["a", "b"]).count() == 0


def test_sketches_merge_to_any_level(spark):
    df = spark.range(30000).selectExpr("id % 3 AS g", "id % 7 AS h", "CASE WHEN id % 11 > 0 THEN id % 9000 END AS v")
    fine = sketches.distinct_sketches(df, ["g", "h"], {"n": "v"})
    for keys in (["g"], ["h"], []):
        guess = sketches.estimates(sketches.merged(fine, keys, ["n"]), ["n"]).collect()
        exact = {tuple(r[k] for k in keys): r["n"] for r in df.groupBy(*keys).agg(F.countDistinct("v").alias("n")).collect()}
        assert len(guess) == len(exact)
        assert all(abs(r["n"] - exact[tuple(r[k] for k in keys)]) <= sketches.relative_error() * r["n"] for r in guess)
