"""Queries on tables where one key holds a third of the rows, its group cut into many slices."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from registry.base import WINDOW_ROWS
from test_registry import ordered

# one order, one supplier, one customer and one user get a third of the rows
HOT = {
    "lineitem": "SELECT * REPLACE (CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE l_orderkey END AS l_orderkey,"
    " CASE WHEN (l_partkey + CAST(l_quantity AS INT)) % 3 = 0 THEN 7 ELSE l_suppkey END AS l_suppkey)",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey)",
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 3 ELSE user_id END AS user_id)",
}
QUERIES = [
    "batter_seasons", "pitcher_lines", "outs_recorded", "order_spots", "line_state_change",
    "supplier_rate_line", "ordered_events", "first_order_of_year", "mean_of_means", "missing_key_join",
]


@pytest.fixture(scope="module")
def hot(tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hot"))
    con = duckdb.connect()
    for path in glob.glob(f"{tables}/*.parquet"):
        name = os.path.basename(path)[:-8]
        target = f"{folder}/{name}.parquet"
        con.execute(f"COPY ({HOT.get(name, 'SELECT *')} FROM '{path}') TO '{target}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{target}'")
    yield folder, con
    con.close()


@pytest.mark.parametrize("name", QUERIES)
def test_query_with_a_hot_key(spark, hot, name):
    # what a task may hold of a group: the hot groups are cut
    spark.conf.set(WINDOW_ROWS, 150)
    folder, con = hot
    try:
        df = entry.queries()[name](spark, folder)
        spark.catalog.clearCache()
        cursor = con.execute(entry.oracle_sql()[name])
        assert ordered(df.columns, df.collect()) == ordered([d[0] for d in cursor.description], cursor.fetchall())
    finally:
        spark.conf.unset(WINDOW_ROWS)
