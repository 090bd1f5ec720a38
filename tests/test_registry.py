"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
import registry

@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for path in glob.glob(f"{tables}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    out = [tuple(plain(r[i]) for i in at) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), 0 if v is None else v) for v in r))


#: minutes each; tools/check_queries.py runs them, and TALLYFOLD_ALL=1 here
SLOW = {"boosting_round_losses", "raced_search_scores"}


@pytest.mark.parametrize("name", sorted(n for n in registry.SQL if n not in SLOW or os.environ.get("TALLYFOLD_ALL")))
def test_query_equals_sql(spark, duck, tables, name):
    df = entry.queries()[name](spark, tables)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered(df.columns, df.collect()) == ordered(columns, cursor.fetchall())


def test_every_query_but_the_text_ones_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_seasons_reach_the_scan(spark, tables):
    for name in ("pivot_years", "history_classes", "projected_year", "predicted_and_actual", "rmse_by_stat", "projection_metrics",
                 "backtest_grid", "best_weight_pairs"):
        plan = entry.queries()[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
        pushed = [x for x in plan.splitlines() if "PushedFilters" in x and "o_orderdate" in x]
        assert pushed and all("GreaterThanOrEqual(o_orderdate" in x and "LessThan(o_orderdate" in x for x in pushed), name


def test_capped_input_is_read_once(spark, tables):
    df = entry.queries()["reliever_rows_capped_by_data"](spark, tables)
    assert "FileScan" not in df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
