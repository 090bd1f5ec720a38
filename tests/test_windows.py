"""Scans over ordered groups: cut groups must give what plain windows give."""

import random
from collections import defaultdict

import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from tallyfold.operators import windows


def skewed(seed=0, n=3000):
    """A third of the rows in one group, a few more large ones, one missing key."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = rng.choice(["hot"] * 5 + ["warm"] * 3 + [None] * 2 + [f"k{rng.randrange(200)}"] * 5)
        rows.append((k, rng.randrange(50) if k == "warm" else i, i, rng.choice([None, 0, 1, 2]), rng.randrange(1000)))
    rng.shuffle(rows)
    return rows


SCHEMA = "k string, o int, id int, s int, v int"


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = {}
    for rs in groups.values():
        rs.sort(key=lambda r: (r[1], r[2]))
        total = 0
        for i, r in enumerate(rs):
            out[r[2]] = (i + 1, rs[i - 1][3] if i else None, total, max(x[4] for x in rs))
            total += r[4]
    return out


@pytest.mark.parametrize("rows_per_task", [None, 400, 25])
@pytest.mark.parametrize("parts", [1, 5])
def test_ordered_scan(spark, rows_per_task, parts):
    rows = skewed(parts)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = windows.ordered_scan(
        df, ["k"], ["o", "id"], row_number="n", previous={"prev": "s"}, sum_before={"run": "v"}, group_max={"top": "v"}, rows=rows_per_task
    )
    assert set(out.columns) == {"k", "o", "id", "s", "v", "n", "prev", "run", "top"}
    got = {r["id"]: (r["n"], r["prev"], r["run"], r["top"]) for r in out.collect()}
    assert got == brute(rows)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_large_groups_are_cut(spark):
    df = spark.createDataFrame(skewed(), SCHEMA).repartition(4)
    cuts = windows.find_cuts(df, ["k"], ["o", "id"], 300)
    assert {g for g, _, _ in cuts.groups} == {("hot",), ("warm",), (None,)}
    assert windows.find_cuts(df, ["k"], ["o", "id"], 3000) is None and windows.find_cuts(df, ["k"], ["o", "id"], 2000) is None
    sizes = cuts.slice(df).groupBy("k", "_slice").count().filter("_slice IS NOT NULL").collect()
    assert sum(r["count"] for r in sizes) > 1500 and max(r["count"] for r in sizes) < 450
    # rows are dealt out once, and a table without large groups keeps the plain plan
    out = windows.ordered_scan(df, ["k"], ["o", "id"], row_number="n", rows=2000)
    assert "Join" not in plan(out)


def test_nothing_depends_on_the_cache(spark):
    rows = [("hot" if i % 10 else "warm", (i * 7919) % 20011, i, i % 3, i % 1000) for i in range(20000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = windows.ordered_scan(df, ["k"], ["o", "id"], row_number="n", previous={"p": "s"}, rows=1500)
    wide = out.withColumn("further", F.concat("k", "v"))
    spark.catalog.clearCache()
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        got = {r["id"]: (r["n"], r["p"]) for r in wide.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == {i: v[:2] for i, v in brute(rows).items()}
    assert "InMemoryRelation" not in plan(out)


def test_a_missing_order_value_comes_first(spark):
    df = spark.createDataFrame([("g", None if i == 0 else i, i) for i in range(30)], "k string, o int, id int")
    out = windows.ordered_scan(df, ["k"], ["o"], row_number="n", previous={"p": "id"}, rows=4)
    assert [(r["n"], r["p"]) for r in as_dicts(out, "id")] == [(i + 1, i - 1 if i else None) for i in range(30)]


@pytest.mark.parametrize("rows_per_task", [None, 150])
def test_rank_with_ties(spark, rows_per_task):
    rows = skewed(3)
    df = spark.createDataFrame(rows, SCHEMA)
    out = windows.competition_rank(df, ["k"], ["o"], "r", rows_per_task)
    want = {r[2]: 1 + sum(1 for x in rows if x[0] == r[0] and x[1] < r[1]) for r in rows}
    assert {r["id"]: r["r"] for r in out.collect()} == want


@pytest.mark.parametrize("rows_per_task", [None, 100, 30])
def test_copies_of_one_order_value(spark, rows_per_task):
    # a third of the table is one value of one group: ranks stay whole
    rows = [("hot", 7, i, 0, 0) for i in range(500)] + [("hot", i, 1000 + i, 0, 0) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = windows.competition_rank(df, ["k"], ["o"], "r", rows_per_task)
    got = {r["id"]: r["r"] for r in out.collect()}
    assert len(got) == 1500
    assert all(got[i] == 8 for i in range(500)) and got[1007] == 8 and got[1008] == 1 + 8 + 500
    if rows_per_task:
        # the copies have a slice of their own, dealt over several tasks; ranks are not joined to rows
        parts = windows.find_cuts(df, ["k"], ["o"], rows_per_task).slice(df).filter("o = 7").groupBy("_slice", "_spread").count().collect()
        assert len({r["_slice"] for r in parts}) == 1 and len(parts) > 3
        assert sum(r["count"] for r in parts) == 501 and max(r["count"] for r in parts) < 3 * rows_per_task


@pytest.mark.parametrize("order", ["double", "string", "timestamp", "timestamp_ntz", "date", "decimal(10,2)"])
def test_cuts_of_any_type(spark, order):
    value = {
        "double": "CASE WHEN id % 50 = 0 THEN CAST('NaN' AS DOUBLE) WHEN id % 50 = 1 THEN NULL ELSE id / 7 END",
        "string": "CASE WHEN id % 50 = 1 THEN NULL ELSE md5(CAST(id AS STRING)) END",
        "date": "date_add(DATE '2020-01-01', CAST(id AS INT))",
        "decimal(10,2)": "CAST(id * 1.25 AS DECIMAL(10,2))",
    }.get(order, f"CAST(TIMESTAMP '2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT), 0) AS {order})")
    df = spark.range(800).selectExpr("id", f"{value} AS o").repartition(3)
    plain = windows.ordered_scan(df, [], ["o", "id"], row_number="n", previous={"p": "id"})
    cut = windows.ordered_scan(df, [], ["o", "id"], row_number="n", previous={"p": "id"}, rows=90)
    assert as_dicts(cut.drop("o"), "id") == as_dicts(plain.drop("o"), "id") and "Join" in plan(cut)


def test_cycle(spark):
    df = spark.createDataFrame([("g", i) for i in range(1, 20)] + [("g", 19)], "g string, ab int")
    spots = sorted((r["ab"], r["spot"]) for r in windows.cyclic_rank(df, ["g"], ["ab"], 9, "spot").collect())
    assert spots[0] == (1, 1) and spots[8] == (9, 9) and spots[17] == (18, 9)
    assert spots[18] == spots[19] == (19, 1)  # a tie shares its place


@pytest.mark.parametrize("rows_per_task", [None, 2])
def test_state_change(spark, rows_per_task):
    rows = [("g", i, s) for i, s in enumerate([0, 1, 1, 0, None, 2, 0, 2])] + [("one", 0, 2)]
    df = spark.createDataFrame(rows, "g string, o int, s int")
    on_last = F.when(F.col("g") == "one", F.lit(9)).otherwise(F.col("d"))
    out = windows.state_change(df, ["g"], ["o"], "s", "d", wrap={-1: 2, -2: 1}, last_by="o", on_last=on_last, rows=rows_per_task)
    got = [r["d"] for r in as_dicts(out, "g", "o")]
    assert got == [0, 1, 0, 2, None, None, 1, 2, 9]


@pytest.mark.parametrize("rows_per_task", [None, 1000, 9])
def test_surrogate_key(spark, rows_per_task):
    keys = list(range(100, 400, 3))
    random.Random(1).shuffle(keys)
    out = windows.surrogate_key(spark.createDataFrame([(k,) for k in keys], "k int").repartition(6), ["k"], "p", "id", rows_per_task)
    assert [r["id"] for r in as_dicts(out, "k")] == [f"p_{i}" for i in range(1, 101)]
