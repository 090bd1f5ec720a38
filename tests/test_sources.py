import math
import os

import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from tallyfold.session import cut_lineage, interim, remove, scratch_path, shared_dir
from tallyfold.sources import kept, read_checked, read_csv, rejected, store_bucketed, with_names, write, write_partitioned

CSV = """,k,x,s
0,1,Inf,a
1,2,-Inf,""
2,3,inf,
3,4,NaN,NA
4,5,NA,b
5,6,,c
6,7,1.5,d
"""


@pytest.fixture
def path(spark, tmp_path):
    file = tmp_path / "in.csv"
    file.write_text(CSV)
    return str(file)


def check(rows):
    x = [r["x"] for r in rows]
    assert x[0] == math.inf and x[1] == -math.inf and x[2] == math.inf and math.isnan(x[3])
    assert x[4:] == [None, None, 1.5]
    assert [r["s"] for r in rows] == ["a", None, None, None, "b", "c", "d"]


def test_read_csv_with_schema(spark, path):
    df = read_csv(spark, path, "_c0 int, k int, x double, s string", drop_index=True)
    assert df.columns == ["k", "x", "s"]
    check(as_dicts(df, "k"))


def test_bad_number_raises(spark, tmp_path):
    file = tmp_path / "bad.csv"
    file.write_text("k,x\n1,oops\n")
    with pytest.raises(Exception, match="oops"):
        read_csv(spark, str(file), "k int, x double").collect()


def test_read_csv_without_schema(spark, tmp_path):
    file = tmp_path / "plain.csv"
    file.write_text("k,x,s\n1,2.5,a\n2,NA,\n")
    assert as_dicts(read_csv(spark, str(file)), "k") == [{"k": 1, "x": 2.5, "s": "a"}, {"k": 2, "x": None, "s": None}]


def test_infinities_are_guessed(spark, tmp_path):
    file = tmp_path / "guess.csv"
    file.write_text("X,k,v,s\n1,1,inf,inf\n2,2,-Inf,a\n3,3,NaN,\n4,4,NA,1.5\n5,5,1e3,b\n")
    df = read_csv(spark, str(file), drop_index=True)
    assert dict(df.dtypes) == {"k": "int", "v": "double", "s": "string"}
    x = [r["v"] for r in as_dicts(df, "k")]
    assert x[:2] == [math.inf, -math.inf] and math.isnan(x[2]) and x[3:] == [None, 1000.0]


def test_a_real_first_column_is_no_index(spark, tmp_path):
    file = tmp_path / "real.csv"
    file.write_text("player,pt\n1,2\n")
    with pytest.raises(ValueError, match="player"):
        read_csv(spark, str(file), drop_index=True)


def test_a_hot_folder_gets_few_files(spark, tmp_path):
    df = spark.range(4000).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('k', id % 5)) AS k").repartition(16)
    target = write_partitioned(df, str(tmp_path / "f"), ["k"])
    files = [f for _, _, names in os.walk(target) for f in names if f.endswith(".parquet")]
    assert len(files) <= 12 and spark.read.parquet(target).count() == 4000


def test_folders_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    from tallyfold.sources import tables

    df = spark.range(3000).selectExpr("id", "IF(id % 50 = 0, NULL, id % 3) AS k", "concat('v', id % 7) AS v").repartition(8)
    name, seen, real = "spark.sql.maxConcurrentOutputFileWriters", [], tables.setting
    before = spark.conf.get(name)
    monkeypatch.setattr(tables, "setting", lambda s, k, v: (seen.append((k, v)), real(s, k, v))[1])
    target = write_partitioned(df, str(tmp_path / "f"), ["k", "v"])  # 28 folders: more than are open at a time
    assert seen == [(name, str(tables.OPEN_FILES))] and spark.conf.get(name) == before
    back = spark.read.parquet(target)
    count = lambda d: as_dicts(d.groupBy(F.coalesce(F.col("k").cast("int"), F.lit(-1)).alias("k"), "v").count(), "k", "v")
    assert count(back) == count(df) and back.filter("k IS NULL").count() == 60


def test_no_machine_local_folder_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Cluster)


def test_write_and_rename(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5)], "k int, s string, x double")
    for fmt in ("csv", "parquet"):
        target = write(df, str(tmp_path / fmt), fmt)
        back = read_csv(spark, target, df.schema) if fmt == "csv" else spark.read.parquet(target)
        assert as_dicts(with_names(back, ["a", "b", "c"]), "a") == [{"a": 1, "b": "a", "c": None}, {"a": 2, "b": None, "c": 1.5}]


def test_partitioned_folders(spark, tmp_path):
    df = spark.createDataFrame([(0.3, 0.7, "a", 1.0), (0.4, 0.6, "a", 2.0)], "w_prev double, w_last double, stat string, rmse double")
    target = write_partitioned(df, str(tmp_path / "m"), ["w_prev", "w_last"])
    assert os.path.isdir(f"{target}/w_prev=0.3/w_last=0.7")
    assert spark.read.parquet(target).filter("w_prev = 0.4").first()["rmse"] == 2.0


def test_shared_folder_is_used(spark):
    base = shared_dir(spark)
    assert shared_dir(spark) == base and scratch_path(spark, "t").startswith(base)
    df = cut_lineage(spark.range(5).selectExpr("id * 2 AS x"))
    assert "Project" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 5


def test_interim_tables_go_on_leaving(spark):
    outside = write(spark.range(3), scratch_path(spark, "outside"))
    with pytest.raises(RuntimeError), interim(spark):
        gone = write(spark.range(4), scratch_path(spark, "inside"))
        assert os.path.isdir(gone)
        scratch_path(spark, "never-written")
        raise RuntimeError
    assert not os.path.exists(gone)
    assert os.path.isdir(outside)
    remove(spark, outside)


def test_only_interim_tables_are_removed(spark, tmp_path):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    remove(spark, path)
    assert not os.path.exists(path)
    for other in (str(tmp_path), shared_dir(spark), f"{shared_dir(spark)}/../x"):
        with pytest.raises(ValueError, match="interim"):
            remove(spark, other)


def test_checked_reading_loses_no_line(spark, tmp_path):
    lines = ["id,day,x,note", '1,2020-01-31,1.5,"a, ""b"""', "2,2020-02-30,1,z", "3,2020-01-01,inf,NA", "4,2020-01-01", "5,2020-01-01,1,a,b",
             "six,2020-01-01,1,a", '7,,"",', "", "8,2020-01-01,abc,a"]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    checked = read_checked(spark, str(tmp_path), "id bigint, day date, x double, note string")
    good = {r["id"]: tuple(r)[1:] for r in kept(checked).collect()}
    assert set(good) == {1, 3, 7} and good[1][1:] == (1.5, 'a, "b"') and good[3][1:] == (float("inf"), None) and good[7] == (None, None, None)
    bad = {r["_line"]: r["_reason"] for r in rejected(checked).collect()}
    assert set(bad) == {lines[2], lines[4], lines[5], lines[6], lines[9]}
    assert bad[lines[4]] == bad[lines[5]] == "does not have 4 fields"
    assert bad[lines[2]] == "day is no date: 2020-02-30" and bad[lines[6]] == "id is no bigint: six" and bad[lines[9]] == "x is no double: abc"
    assert checked.count() == 8


def test_a_table_stored_by_key_needs_no_shuffle(spark, tmp_path):
    from tallyfold.operators import windows

    df = spark.range(3000).selectExpr("id % 37 AS g", "id % 5 AS h", "id AS o", "id % 11 AS v").repartition(6)
    stored = store_bucketed(df, str(tmp_path / "stored"), ["g", "h"], 4, ["o"])
    scan = windows.ordered_scan(stored, ["g", "h"], ["o"], previous={"p": "v"})
    per_key = scan.groupBy("g", "h").agg(F.sum("p").alias("p"))
    counts = stored.groupBy("g", "h", "v").count().groupBy("g", "h").agg(F.count("v").alias("kinds"))
    both = per_key.join(counts, ["g", "h"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert all(f.endswith(".zstd.parquet") for f in os.listdir(tmp_path / "stored") if f.startswith("part-"))
        assert stored.count() == 3000 and both.count() == df.select("g", "h").distinct().count()
        plain = windows.ordered_scan(df, ["g", "h"], ["o"], previous={"p": "v"}).groupBy("g", "h").agg(F.sum("p").alias("p"))
        assert as_dicts(per_key, "g", "h") == as_dicts(plain, "g", "h")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
