"""Each operator on the test tables as they are."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyfold.functions import (
    completed_years,
    count_where,
    cycle_position,
    finite_or_null,
    is_in,
    is_infinite,
    longer_than,
    null_if_in,
    rate_per,
    ratio,
    remap,
    round_to,
)
from tallyfold.operators import aggregate as agg
from tallyfold.operators import cleaning, columns, joins, metrics, projection, reshape, sketches, windows
from tallyfold.plans.forecast import submission
from tallyfold.session import cut_lineage, remove, scratch_path
from tallyfold.sources import kept, load, read_checked, read_csv, rejected, with_names, write, write_partitioned

from .base import query, window_rows

c = F.col
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
YEARS = (1999, 2000, 2001)
STATS = ["n_orders", "urgent", "finished", "spend"]
GRID = [(i / 10, (10 - i) / 10) for i in range(1, 10)]
BLEND = {
    "n_orders": ((0.2, 0.3, 0.5), (0.4, 0.6)),
    "urgent": ((0.15, 0.25, 0.6), (0.3, 0.7)),
    "finished": ((0.1, 0.2, 0.7), (0.2, 0.8)),
    "spend": ((0.2, 0.3, 0.5), (0.4, 0.6)),
}


def customer_years(spark, sf, years=None):
    """Customer-season panel; money in whole cents, so sums are exact.

    ``years`` keeps the seasons from the first to the last of them, as a range
    of dates, which reaches the scan; a condition on the year would not.
    """
    orders = load(spark, sf, "orders")
    if years:
        first, after = dt.datetime(min(years), 1, 1), dt.datetime(max(years) + 1, 1, 1)
        orders = orders.filter((c("o_orderdate") >= F.lit(first).cast("timestamp_ntz")) & (c("o_orderdate") < F.lit(after).cast("timestamp_ntz")))
    return orders.groupBy(c("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        count_where(c("o_orderpriority") == "1-URGENT").alias("urgent"),
        count_where(c("o_orderstatus") == "F").alias("finished"),
        F.sum(F.round(c("o_totalprice") * 100).cast("long")).alias("spend"),
    )


CY = """cy AS (
  SELECT o_custkey AS custkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n_orders,
    CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS urgent,
    CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS finished,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS spend
  FROM orders GROUP BY 1, 2)"""


def _wide(years=YEARS, name="wide") -> str:
    cols = [f"max(CASE WHEN year = {y} THEN {s} END) AS {s}_{y}" for y in years for s in STATS]
    flags = [f"CAST(count(*) FILTER (WHERE year = {y}) > 0 AS INTEGER) AS in_{y}" for y in years]
    listed = ", ".join(map(str, years))
    return f"{name} AS (SELECT custkey, {', '.join(cols + flags)} FROM cy WHERE year IN ({listed}) GROUP BY custkey)"


CLASS_SQL = """CASE WHEN in_1999 = 1 AND in_2000 = 1 AND in_2001 = 1 THEN 1
  WHEN in_1999 = 0 AND in_2000 = 1 AND in_2001 = 1 THEN 2 WHEN in_1999 = 0 AND in_2000 = 0 AND in_2001 = 1 THEN 3 ELSE 4 END"""


def _blend(stat: str) -> str:
    (w1, w2, w3), (v1, v2) = BLEND[stat]
    return f"""CASE {CLASS_SQL} WHEN 1 THEN {w1}e0 * {stat}_1999 + {w2}e0 * {stat}_2000 + {w3}e0 * {stat}_2001
      WHEN 2 THEN {v1}e0 * {stat}_2000 + {v2}e0 * {stat}_2001 ELSE CAST({stat}_2001 AS DOUBLE) END"""


def _n(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


# --- cleaning, counting, ratios ---------------------------------------------


@query(f"""
WITH a AS (
  SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(DISTINCT hour(ts)) AS BIGINT) AS hours, CAST(count(*) AS BIGINT) AS n,
    {_n("event_type = 'click'")} AS clicks, {_n("event_type = 'view'")} AS views, {_n("event_type = 'purchase'")} AS purchases,
    {_n("event_type = 'error'")} AS errors, {_n("event_type IN ('click', 'purchase', 'signup')")} AS actions
  FROM events GROUP BY 1, 2),
b AS (SELECT *, round_even(CAST(actions AS DOUBLE) / n, 3) AS action_rate, round_even(CAST(clicks AS DOUBLE) / nullif(views, 0), 3) AS click_rate,
        round_even(CAST(n AS DOUBLE) / hours, 3) AS per_hour FROM a)
SELECT *, round_even(action_rate + click_rate, 3) AS both_rates FROM b""")
def entity_period_features(spark, sf):
    events = load(spark, sf, "events").withColumn("day", c("ts").cast("date")).withColumn("hour", F.hour("ts"))
    counts = {
        "hours": agg.distinct_count("hour"),
        "n": F.count(F.lit(1)),
        "clicks": count_where(c("event_type") == "click"),
        "views": count_where(c("event_type") == "view"),
        "purchases": count_where(c("event_type") == "purchase"),
        "errors": count_where(c("event_type") == "error"),
        "actions": count_where(is_in("event_type", ["click", "purchase", "signup"])),
    }
    rates = {
        "action_rate": round_to(ratio("actions", "n")),
        "click_rate": round_to(ratio("clicks", "views")),
        "per_hour": round_to(ratio("n", "hours")),
    }
    return agg.agg_then_derive(
        events, ["user_id", "day"], counts, rates, {"both_rates": round_to(c("action_rate") + c("click_rate"))}
    )


@query("""
SELECT kept, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users
FROM (SELECT user_id, CASE WHEN event_type NOT IN ('error', 'signup') THEN event_type END AS kept FROM events)
WHERE kept IS NOT NULL GROUP BY kept""")
def null_if_codes(spark, sf):
    kept = load(spark, sf, "events").select("user_id", null_if_in("event_type", ["error", "signup"]).alias("kept"))
    return kept.filter(c("kept").isNotNull()).groupBy("kept").agg(
        F.count(F.lit(1)).alias("n"), agg.distinct_count("user_id").alias("users")
    )


@query("""
SELECT user_id, CAST(count(*) AS BIGINT) AS n
FROM (SELECT user_id, CASE WHEN event_type NOT IN ('purchase') THEN event_type END AS e FROM events)
WHERE length(e) > 4 GROUP BY user_id""")
def longer_codes(spark, sf):
    e = load(spark, sf, "events").withColumn("e", null_if_in("event_type", ["purchase"]))
    return agg.group_sizes(e.filter(longer_than("e", 4)), ["user_id"])


def _user_days(spark, sf):
    events = load(spark, sf, "events").withColumn("day", c("ts").cast("date"))
    return events.groupBy("user_id", "day").agg(
        count_where(c("event_type") == "purchase").alias("purchases"),
        count_where(c("event_type") == "error").alias("errors"),
    )


_USER_DAYS = f"""ud AS (SELECT user_id, CAST(ts AS DATE) AS day, {_n("event_type = 'purchase'")} AS purchases,
  {_n("event_type = 'error'")} AS errors FROM events GROUP BY 1, 2)"""
_IEEE = """CASE WHEN errors = 0 THEN CASE WHEN purchases = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END
  ELSE CAST(purchases AS DOUBLE) / errors END"""


@query(f"""WITH {_USER_DAYS}, r AS (SELECT *, {_IEEE} AS x FROM ud)
SELECT user_id, day, CAST(purchases AS DOUBLE) / nullif(errors, 0) AS with_null,
  CASE WHEN isfinite(x) THEN x END AS finite, CASE WHEN isnan(x) THEN 'nan' WHEN isinf(x) THEN 'inf' ELSE 'finite' END AS kind FROM r""")
def ratio_modes(spark, sf):
    x = ratio("purchases", "errors", "ieee")
    return _user_days(spark, sf).select(
        "user_id", "day", ratio("purchases", "errors").alias("with_null"), finite_or_null(x).alias("finite"),
        F.when(F.isnan(x), "nan").when(is_infinite(x), "inf").otherwise("finite").alias("kind"),
    )


@query(f"""WITH {_USER_DAYS}, r AS (SELECT *, {_IEEE} AS x FROM ud)
SELECT user_id, day, CASE WHEN isinf(x) THEN 21e0 WHEN isnan(x) THEN 0e0 ELSE x END AS fixed,
  CASE WHEN isinf(x) THEN (SELECT max(x) FROM r WHERE isfinite(x)) WHEN isnan(x) THEN 0e0 ELSE x END AS from_data FROM r""")
def impute_caps(spark, sf):
    x = ratio("purchases", "errors", "ieee")
    rows = _user_days(spark, sf).select("user_id", "day", x.alias("fixed"), x.alias("from_data"))
    return cleaning.impute(rows, {"fixed": (21, 0), "from_data": ("max", 0)})


@query(f"""WITH {_USER_DAYS}, r AS (SELECT *, {_IEEE} AS x FROM ud)
SELECT 'kept' AS part, CAST(count(*) AS BIGINT) AS n, CAST(sum(purchases) AS BIGINT) AS purchases FROM r WHERE isfinite(x)
UNION ALL SELECT 'filled', CAST(count(*) AS BIGINT), CAST(sum(CASE WHEN isfinite(x) AND x > 1 THEN 1 ELSE 0 END) AS BIGINT) FROM r
UNION ALL SELECT 'complete', CAST(count(*) AS BIGINT), CAST(sum(purchases) AS BIGINT) FROM r WHERE isfinite(x)""")
def clean_finite(spark, sf):
    rows = _user_days(spark, sf).withColumn("x", ratio("purchases", "errors", "ieee"))
    total = lambda df, part, value: df.agg(
        F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("purchases")
    )
    kept = cleaning.finite_rows(rows, ["x"])
    filled = cleaning.zero_fill(rows, ["x"])
    complete = cleaning.drop_incomplete(cleaning.inf_to_null(rows))
    return joins.union_all(
        total(kept, "kept", c("purchases")),
        total(filled, "filled", (c("x") > 1).cast("long")),
        total(complete, "complete", c("purchases")),
    )


@query("""
SELECT user_id, CAST(count(*) FILTER (WHERE e = 'click') AS BIGINT) AS lenient,
  CASE WHEN count(e) = count(*) THEN CAST(count(*) FILTER (WHERE e = 'click') AS BIGINT) END AS strict,
  CAST(count(DISTINCT e) AS BIGINT) AS kinds, CAST(count(DISTINCT coalesce(e, '')) AS BIGINT) AS kinds_with_missing
FROM (SELECT user_id, CASE WHEN NOT (event_type IN ('error') AND value > 60) THEN event_type END AS e FROM events) GROUP BY user_id""")
def strict_missing_counts(spark, sf):
    big_error = (c("event_type") == "error") & (c("value") > 60)
    events = load(spark, sf, "events").select("user_id", F.when(~big_error, c("event_type")).alias("e"))
    return events.groupBy("user_id").agg(
        count_where(c("e") == "click").alias("lenient"),
        count_where(c("e") == "click", strict_null=True).alias("strict"),
        agg.distinct_count("e").alias("kinds"),
        agg.distinct_count("e", count_missing=True).alias("kinds_with_missing"),
    )


@query("""
SELECT o_orderkey, CAST(2002 - year(o_orderdate) - CAST(401 < month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS BIGINT) AS age FROM orders""")
def age_at(spark, sf):
    age = completed_years(c("o_orderdate"), F.lit("2002-04-01"))
    return load(spark, sf, "orders").select("o_orderkey", age.alias("age"))


@query("""
SELECT l_linenumber, CAST(sum((l_linenumber - 1) % 3 + 1) AS BIGINT) AS cycled,
  CAST(sum(CASE l_linenumber WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE l_linenumber END) AS BIGINT) AS remapped,
  CAST(count(*) AS BIGINT) AS n, 9e0 * (CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*)) AS per_nine FROM lineitem GROUP BY 1""")
def scalar_functions(spark, sf):
    lines = load(spark, sf, "lineitem")
    out = lines.groupBy("l_linenumber").agg(
        F.sum(cycle_position("l_linenumber", 3)).alias("cycled"),
        F.sum(remap("l_linenumber", {1: 10, 2: 20})).alias("remapped"),
        F.count(F.lit(1)).alias("n"),
        F.sum(c("l_quantity").cast("long")).alias("q"),
    )
    return out.withColumn("per_nine", rate_per("q", "n", 9)).drop("q")


# --- joins ------------------------------------------------------------------


@query("""
SELECT cn.n_name AS buyer, sn.n_name AS seller, CAST(count(*) AS BIGINT) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2""")
def role_dims(spark, sf):
    # the nation keys travel; lines are counted once per pair of them, and the names meet a few pairs
    customer = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    supplier = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    orders = joins.left(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), customer, left_on=["o_custkey"], right_on=["c_custkey"])
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(orders, c("l_orderkey") == c("o_orderkey"))
    lines = joins.left(lines, supplier, left_on=["l_suppkey"], right_on=["s_suppkey"])
    pairs = agg.group_sizes(lines, ["c_nationkey", "s_nationkey"], "lines")
    nation = load(spark, sf, "nation").select("n_nationkey", "n_name")
    named = joins.role_join(pairs, nation, "n_nationkey", {"c_nationkey": "_buyer", "s_nationkey": "_seller"})
    return named.groupBy(c("n_name_buyer").alias("buyer"), c("n_name_seller").alias("seller")).agg(F.sum("lines").alias("lines"))


@query(f"""
WITH e AS (SELECT user_id, CASE WHEN event_type NOT IN ('error') THEN event_type END AS k FROM events),
d AS (SELECT k, CAST(count(*) AS BIGINT) AS n_kind FROM e GROUP BY k)
SELECT 'plain' AS rule, e.user_id, CAST(sum(n_kind) AS BIGINT) AS total FROM e LEFT JOIN d ON e.k = d.k GROUP BY ALL
UNION ALL
SELECT 'null_safe', e.user_id, CAST(sum(n_kind) AS BIGINT) FROM e LEFT JOIN d ON e.k IS NOT DISTINCT FROM d.k GROUP BY ALL""")
def missing_key_join(spark, sf):
    e = load(spark, sf, "events").select("user_id", null_if_in("event_type", ["error"]).alias("k"))
    # few distinct codes hold all rows: count per user and code first, so the join meets counts
    e = agg.group_sizes(e, ["user_id", "k"])
    d = e.groupBy("k").agg(F.sum("n").alias("n_kind"))
    parts = [
        joins.left(e, d, on=["k"], null_safe=safe)
        .groupBy(F.lit(rule).alias("rule"), "user_id")
        .agg(F.sum(c("n") * c("n_kind")).alias("total"))
        for rule, safe in (("plain", False), ("null_safe", True))
    ]
    return joins.union_all(*parts)


@query("""SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_line_keys(spark, sf):
    return joins.duplicate_keys(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_MOM = """mom AS (SELECT l_suppkey, l_returnflag, round(avg(m), 9) AS mean_qty, CAST(sum(n) AS BIGINT) AS lines FROM (
  SELECT l_suppkey, l_returnflag, l_orderkey, avg(l_quantity) AS m, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1, 2)"""
_TLM = """tl AS (SELECT l_suppkey, l_returnflag, CAST(sum(m) AS BIGINT) AS top_lines FROM (
  SELECT l_suppkey, l_returnflag, l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY ALL) GROUP BY 1, 2)"""


def _mean_of_means(spark, sf):
    lines = load(spark, sf, "lineitem").withColumn("lines", F.lit(1).cast("long")).withColumn("mean_qty", c("l_quantity"))
    out = agg.mean_of_means(lines, ["l_suppkey", "l_returnflag"], ["l_orderkey"], ["mean_qty"], ["lines"])
    return out.withColumn("mean_qty", F.round("mean_qty", 9))


def _two_level_max(spark, sf):
    return agg.rollup_max_sum(load(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_orderkey"], "l_linenumber", "top_lines")


@query(f"WITH {_MOM} SELECT * FROM mom")
def mean_of_means(spark, sf):
    return _mean_of_means(spark, sf)


@query(f"WITH {_TLM} SELECT * FROM tl")
def two_level_max_sum(spark, sf):
    return _two_level_max(spark, sf)


@query(f"""WITH {_MOM}, {_TLM} SELECT mom.*, tl.l_returnflag AS other_flag, top_lines FROM mom LEFT JOIN tl ON mom.l_suppkey = tl.l_suppkey""")
def fanout_join(spark, sf):
    other = _two_level_max(spark, sf).withColumnRenamed("l_returnflag", "other_flag")
    return joins.left(_mean_of_means(spark, sf), other, on=["l_suppkey"], expect="m:n")


# --- windows ----------------------------------------------------------------

_SPOTS = [f"spot{i:02d}" for i in range(1, 10)]


@query(f"""
WITH r AS (SELECT l_suppkey, (rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) % 9 + 1 AS spot FROM lineitem),
a AS (SELECT l_suppkey, {', '.join(f'{_n(f"spot = {i}")} AS {s}' for i, s in enumerate(_SPOTS, 1))} FROM r GROUP BY 1),
t AS (SELECT *, {' + '.join(_SPOTS)} AS total FROM a),
s AS (SELECT *, {', '.join(f'CAST({s} AS DOUBLE) / total * 100 AS {s}_per' for s in _SPOTS)} FROM t)
SELECT *, round((0e0 + {' + '.join(f'{i} * {s}_per' for i, s in enumerate(_SPOTS, 1))}) / 100, 9) AS mean_spot FROM s""")
def order_spots(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    placed = windows.cyclic_rank(lines, ["l_orderkey"], ["l_linenumber"], 9, "spot", window_rows(spark))
    counted = agg.counts_by_code(placed, ["l_suppkey"], "spot", dict(enumerate(_SPOTS, 1)))
    shared = agg.shares(counted.withColumn("total", columns.horizontal_sum(_SPOTS)), _SPOTS, "total")
    return shared.withColumn("mean_spot", F.round(agg.weighted_position([f"{s}_per" for s in _SPOTS]), 9))


_CHANGE = f"""
s0 AS (SELECT *, CAST(l_quantity AS INTEGER) % 3 AS state FROM lineitem),
s1 AS (SELECT *, row_number() OVER w AS nth, lag(state) OVER w AS prev, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS final
       FROM s0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)})),
s2 AS (SELECT *, CASE WHEN nth = 1 THEN 0 ELSE state - prev END AS d FROM s1),
sc AS (SELECT *, CASE WHEN l_linenumber = final AND l_returnflag = 'A' THEN 1 WHEN l_linenumber = final AND l_returnflag = 'R' THEN 2
         WHEN d = -1 THEN 2 WHEN d = -2 THEN 1 ELSE d END AS change FROM s2)"""


def _changes(spark, sf):
    lines = load(spark, sf, "lineitem").select(*LINE_ORDER, "l_orderkey", "l_returnflag", "l_linestatus", (c("l_quantity").cast("int") % 3).alias("state"), "l_extendedprice")
    last = F.when(c("l_returnflag") == "A", 1).when(c("l_returnflag") == "R", 2).otherwise(c("change"))
    return windows.state_change(
        lines, ["l_orderkey"], LINE_ORDER, "state", wrap={-1: 2, -2: 1}, last_by="l_linenumber", on_last=last, rows=window_rows(spark)
    )


@query(f"WITH {_CHANGE} SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(change) AS BIGINT) AS total, CAST(max(change) AS INTEGER) AS most FROM sc GROUP BY 1")
def line_state_change(spark, sf):
    return _changes(spark, sf).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("change").alias("total"), F.max("change").alias("most")
    )


@query(f"""WITH {_CHANGE},
a AS (SELECT l_suppkey, l_linestatus, CAST(sum(change) AS BIGINT) AS outs, {_n("l_returnflag IN ('A', 'R')")} AS hits, {_n("l_returnflag = 'N'")} AS walks FROM sc GROUP BY 1, 2),
b AS (SELECT l_suppkey, l_linestatus, CAST(sum(m) AS BIGINT) AS faced FROM (SELECT l_suppkey, l_linestatus, l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY ALL) GROUP BY 1, 2),
i AS (SELECT *, CAST(outs AS DOUBLE) / 3 AS innings FROM a)
SELECT i.*, hits / nullif(innings, 0) * 9e0 AS hits_nine, walks / nullif(innings, 0) * 9e0 AS walks_nine,
  CAST(hits AS DOUBLE) / nullif(walks, 0) AS hits_per_walk, faced
FROM i LEFT JOIN b ON i.l_suppkey = b.l_suppkey AND i.l_linestatus = b.l_linestatus""")
def supplier_rate_line(spark, sf):
    keys = ["l_suppkey", "l_linestatus"]
    aggs = {
        "outs": F.sum("change"),
        "hits": count_where(is_in("l_returnflag", ["A", "R"])),
        "walks": count_where(c("l_returnflag") == "N"),
    }
    rates = {
        "hits_nine": rate_per("hits", "innings", 9),
        "walks_nine": rate_per("walks", "innings", 9),
        "hits_per_walk": ratio("hits", "walks"),
    }
    line = agg.agg_then_derive(_changes(spark, sf), keys, aggs, {"innings": ratio("outs", F.lit(3))}, rates)
    faced = agg.rollup_max_sum(load(spark, sf, "lineitem"), keys, ["l_orderkey"], "l_linenumber", "faced")
    return joins.left(line, faced, on=keys)


@query("SELECT s_suppkey, 'supplier_' || row_number() OVER (ORDER BY s_suppkey) AS supplier_id FROM supplier")
def surrogate_keys(spark, sf):
    return windows.surrogate_key(load(spark, sf, "supplier").select("s_suppkey"), ["s_suppkey"], "supplier", "supplier_id", window_rows(spark))


@query("""SELECT user_id, event_id, CAST(row_number() OVER w AS BIGINT) AS nth, lag(event_type) OVER w AS previous,
  CAST(max(event_id) OVER (PARTITION BY user_id) AS BIGINT) AS last_event FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def ordered_events(spark, sf):
    events = load(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return windows.ordered_scan(
        events, ["user_id"], ["ts", "event_id"], row_number="nth", previous={"previous": "event_type"}, group_max={"last_event": "event_id"},
        rows=window_rows(spark),
    ).drop("ts", "event_type")


# --- panels and projection --------------------------------------------------


@query(f"WITH {CY}, {_wide()} SELECT * FROM wide")
def pivot_years(spark, sf):
    return reshape.pivot_wide(customer_years(spark, sf, YEARS), "custkey", "year", STATS, YEARS)


@query(f"WITH {CY} SELECT custkey, year, stat, CAST(value AS DOUBLE) AS value FROM (UNPIVOT cy ON n_orders, urgent, finished, spend INTO NAME stat VALUE value)")
def long_stats(spark, sf):
    return reshape.to_long(customer_years(spark, sf), ["custkey", "year"], STATS)


@query(f"WITH {CY}, {_wide()} SELECT in_1999, in_2000, in_2001, {CLASS_SQL} AS history, CAST(count(*) AS BIGINT) AS n FROM wide GROUP BY ALL")
def history_classes(spark, sf):
    wide = reshape.pivot_wide(customer_years(spark, sf, YEARS), "custkey", "year", STATS, YEARS)
    return agg.group_sizes(wide.withColumn("history", projection.history_class(YEARS)), ["in_1999", "in_2000", "in_2001", "history"])


@query(f"WITH {CY}, {_wide()} SELECT custkey, {', '.join(f'round({_blend(s)}, 6) AS {s}' for s in STATS)} FROM wide")
def projected_year(spark, sf):
    out = projection.project_next(customer_years(spark, sf, YEARS), "custkey", "year", BLEND, YEARS)
    return out.withColumns({s: F.round(s, 6) for s in STATS})


def _pred(stat: str, w1, w2) -> str:
    return f"CASE WHEN in_1999 = 1 AND in_2000 = 1 THEN {w1}e0 * {stat}_1999 + {w2}e0 * {stat}_2000 ELSE CAST({stat}_2000 AS DOUBLE) END"


_ACTUAL = f"act AS (SELECT custkey AS k, {', '.join(f'{s} AS y_{s}' for s in STATS)} FROM cy WHERE year = 2001), jj AS (SELECT * FROM wide JOIN act ON custkey = k)"
_TWO = _wide((1999, 2000))
_METRICS = " UNION ALL ".join(
    f"SELECT '{s}' AS stat, {w1}e0 AS w_prev, {w2}e0 AS w_last, round(sqrt(avg(({_pred(s, w1, w2)} - y_{s}) * ({_pred(s, w1, w2)} - y_{s}))), 4) AS rmse FROM jj"
    for s in STATS
    for w1, w2 in GRID
)


def _side_by_side(spark, sf):
    return projection.predicted_vs_actual(customer_years(spark, sf, YEARS), "custkey", "year", STATS, YEARS[:2], YEARS[2], 0.4, 0.6)


@query(f"WITH {CY}, {_TWO}, {_ACTUAL} SELECT custkey, {', '.join(f'round({_pred(s, 0.4, 0.6)}, 6) AS {s}_pred, y_{s} AS {s}_actual' for s in STATS)} FROM jj")
def predicted_and_actual(spark, sf):
    return _side_by_side(spark, sf).withColumns({f"{s}_pred": F.round(f"{s}_pred", 6) for s in STATS})


@query(f"""WITH {CY}, {_TWO}, {_ACTUAL} """ + " UNION ALL ".join(
    f"SELECT '{s}' AS stat, round(sqrt(avg(({_pred(s, 0.4, 0.6)} - y_{s}) * ({_pred(s, 0.4, 0.6)} - y_{s}))), 4) AS rmse FROM jj" for s in STATS))
def rmse_by_stat(spark, sf):
    return metrics.rmse_per_stat(_side_by_side(spark, sf), STATS).withColumn("rmse", F.round("rmse", 4))


@query(f"""WITH {CY}, {_TWO}, {_ACTUAL}, e AS (SELECT CAST(y_spend AS DOUBLE) AS y, {_pred('spend', 0.4, 0.6)} AS p FROM jj)
SELECT CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
  round(avg(abs((y - p) / nullif(y, 0))) * 100, 6) AS mape FROM e""")
def projection_metrics(spark, sf):
    out = metrics.regression_metrics(_side_by_side(spark, sf), "spend_actual", "spend_pred")
    return out.withColumns({"rmse": F.round("rmse", 4), "mae": F.round("mae", 4), "mape": F.round("mape", 6)})


@query(f"""WITH {CY}, {_TWO}, {_ACTUAL}, e AS (SELECT CAST(y_urgent AS DOUBLE) AS y, {_pred('urgent', 0.4, 0.6)} AS p FROM jj)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(abs((y - p) / (y + 0.5e0))) * 100, 6) AS mape FROM e""")
def shifted_percent_errors(spark, sf):
    # many actual values are 0: the shift keeps these rows
    out = metrics.regression_metrics(_side_by_side(spark, sf), "urgent_actual", "urgent_pred", eps=0.5)
    return out.select("n", F.round("mape", 6).alias("mape"))


def _grid_metrics(spark, sf):
    out = projection.backtest_weights(customer_years(spark, sf, YEARS), "custkey", "year", STATS, YEARS[:2], YEARS[2], GRID)
    return out.withColumn("rmse", F.round("rmse", 4))


@query(f"WITH {CY}, {_TWO}, {_ACTUAL} {_METRICS}")
def backtest_grid(spark, sf):
    return _grid_metrics(spark, sf)


@query(f"WITH {CY}, {_TWO}, {_ACTUAL}, m AS ({_METRICS}) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY stat ORDER BY rmse, w_prev) = 1")
def best_weight_pairs(spark, sf):
    return projection.best_weights(_grid_metrics(spark, sf))


@query("""SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) = 1""")
def first_order_of_year(spark, sf):
    orders = load(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return agg.dedupe_first(orders, ["o_custkey", "year"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "year", "o_orderkey", "o_orderpriority")


@query(f"""WITH {CY} SELECT 'train' AS part, year, CAST(count(*) AS BIGINT) AS n, CAST(sum(spend) AS BIGINT) AS spend FROM cy WHERE year <= 2000 GROUP BY ALL
UNION ALL SELECT 'test', year, CAST(count(*) AS BIGINT), CAST(sum(spend) AS BIGINT) FROM cy WHERE year = 2001 GROUP BY ALL""")
def period_split(spark, sf):
    train, test = cleaning.time_split(customer_years(spark, sf), "year", range(1995, 2001), [2001])
    both = joins.union_all(columns.with_const(train, "part", "train"), columns.with_const(test, "part", "test"))
    return both.groupBy("part", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("spend").alias("spend"))


@query(f"WITH {CY} " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 8) AS corr FROM cy" for i, a in enumerate(STATS) for b in STATS[i + 1:]))
def feature_correlations(spark, sf):
    return metrics.corr_pairs(customer_years(spark, sf), STATS).withColumn("corr", F.round("corr", 8))


def _ranked(names) -> str:
    return ", ".join(
        f"rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2e0 AS {s}" for s in names
    )


@query(f"WITH {CY}, r AS (SELECT {_ranked(STATS)} FROM cy) " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 8) AS corr FROM r" for i, a in enumerate(STATS) for b in STATS[i + 1:]))
def feature_rank_correlations(spark, sf):
    out = metrics.corr_pairs(customer_years(spark, sf), STATS, "spearman", ["custkey", "year"], window_rows(spark))
    return out.withColumn("corr", F.round("corr", 8))


_MANY = {f"f{i}": f"(l_partkey * {2 * i + 1} + l_orderkey * {i % 7}) % {11 + 3 * i}" for i in range(40)}


@query(f"WITH x AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _MANY.items())} FROM lineitem), " + """
l AS (SELECT * FROM (SELECT """ + ", ".join(f"corr(f{i}, f{j}) AS f{i}_f{j}" for i in range(40) for j in range(i + 1, 40)) + """ FROM x))
SELECT split_part(pair, '_', 1) AS feature_a, split_part(pair, '_', 2) AS feature_b, round(corr, 8) AS corr
FROM (UNPIVOT l ON COLUMNS(*) INTO NAME pair VALUE corr)""")
def many_feature_correlations(spark, sf):
    lines = load(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _MANY.items()])
    return metrics.corr_pairs(lines, list(_MANY)).withColumn("corr", F.round("corr", 8))


@query("""
SELECT 'flag' AS level, l_returnflag AS flag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS orders,
  true AS parts_close, true AS orders_close FROM lineitem GROUP BY 2
UNION ALL SELECT 'all', NULL, count(DISTINCT l_partkey), count(DISTINCT l_orderkey), true, true FROM lineitem""")
def sketched_distinct_counts(spark, sf):
    """Exact counts, and whether the estimates merged from stored sketches per flag and month lie within their error."""
    lines = load(spark, sf, "lineitem").select("l_returnflag", "l_partkey", "l_orderkey", F.trunc(c("l_shipdate").cast("date"), "month").alias("month"))
    names = {"parts": "l_partkey", "orders": "l_orderkey"}
    path = write(sketches.distinct_sketches(lines, ["l_returnflag", "month"], names), scratch_path(spark, "sketches"))
    stored = spark.read.parquet(path)
    bound = sketches.relative_error()
    levels = []
    for level, flag in (("flag", c("l_returnflag")), ("all", F.lit("every"))):
        guess = sketches.estimates(sketches.merged(stored.withColumn("flag", flag), ["flag"], list(names)), list(names))
        guess = guess.withColumnsRenamed({n: f"{n}_guess" for n in names})
        exact = lines.withColumn("flag", flag).groupBy("flag").agg(*[agg.distinct_count(v).alias(n) for n, v in names.items()])
        close = {f"{n}_close": F.abs(c(f"{n}_guess") - c(n)) <= F.greatest(F.lit(1.0), bound * c(n)) for n in names}
        both = exact.join(guess, "flag").withColumns(close)
        shown = F.when(F.lit(level == "flag"), c("flag"))
        levels.append(both.select(F.lit(level).alias("level"), shown.alias("flag"), *names, *close))
    out = cut_lineage(joins.union_all(*levels))
    remove(spark, path)
    return out


# --- names, distinct, top rows ----------------------------------------------


@query(f"""WITH {CY} SELECT custkey AS customer, year AS season, n_orders AS orders_stat, finished AS finished_stat, spend AS spend_stat, 2 AS source FROM cy""")
def renamed_columns(spark, sf):
    df = columns.rename(customer_years(spark, sf).drop("urgent"), {"custkey": "customer", "year": "season", "n_orders": "orders"})
    df = columns.add_suffix(df, ["orders", "finished", "spend"], "_stat_x")
    assert columns.columns_like(df, "_stat") == columns.columns_matching(df, "_stat_x$")
    df = columns.strip_suffix(columns.keep_suffix(df, ["customer", "season"], "_stat_x"), "_x")
    return columns.with_const(df, "source", 2)


@query(f"""WITH {CY}, t AS (SELECT year, n_orders, finished FROM cy) SELECT 'drop_first' AS chosen, CAST(sum(n_orders + finished) AS BIGINT) AS total FROM t
UNION ALL SELECT 'like_in', CAST(sum(finished + n_orders + spend + urgent) AS BIGINT) FROM cy
UNION ALL SELECT 'matching_end', CAST(sum(spend) AS BIGINT) FROM cy""")
def chosen_columns(spark, sf):
    cy = customer_years(spark, sf)
    first_gone = columns.drop_first(cy.select("custkey", "n_orders", "finished"))
    tagged = columns.add_suffix(cy, STATS, "_in_all")
    picks = {
        "drop_first": (first_gone, first_gone.columns),
        "like_in": (tagged, columns.columns_like(tagged, "_in_")),
        "matching_end": (tagged, columns.columns_matching(tagged, "^sp.*_all$")),
    }
    parts = [
        df.agg(F.lit(name).alias("chosen"), F.sum(columns.horizontal_sum(cols)).alias("total")) for name, (df, cols) in picks.items()
    ]
    return joins.union_all(*parts)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_codes(spark, sf):
    return agg.distinct_values(load(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query(f"WITH {CY}, t AS (SELECT custkey, CAST(sum(spend) AS BIGINT) AS spend FROM cy GROUP BY 1) SELECT * FROM t ORDER BY spend DESC, custkey LIMIT 10")
def top_spenders(spark, sf):
    # a top-k report: the limit is the question
    totals = customer_years(spark, sf).groupBy("custkey").agg(F.sum("spend").alias("spend"))
    return totals.orderBy(c("spend").desc(), "custkey").limit(10)


@query(f"""WITH {CY} SELECT year, {', '.join(f'CAST(sum({s} * w) AS DOUBLE) AS {s}' for s in STATS)}
FROM (SELECT *, CASE WHEN year >= 2000 THEN 4 ELSE 1 END AS w FROM cy) GROUP BY year""")
def weighted_sums(spark, sf):
    from tallyfold.functions import weighted_sum

    w = customer_years(spark, sf).withColumn("w", F.when(c("year") >= 2000, 4).otherwise(1))
    return w.groupBy("year").agg(*[weighted_sum(s, "w").cast("double").alias(s) for s in STATS])


# --- stacking and submission ------------------------------------------------

_SOURCES = """
a AS (SELECT o_custkey AS k, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
b AS (SELECT o_custkey AS k, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1),
s AS (SELECT k, CAST(sum(v) AS BIGINT) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k)"""


def _sources(spark, sf):
    orders = load(spark, sf, "orders")
    a = orders.filter(c("o_orderpriority") == "1-URGENT").groupBy("o_custkey").agg(F.sum(F.round(c("o_totalprice") * 100).cast("long")).alias("v"))
    lines = load(spark, sf, "lineitem").filter((c("l_returnflag") == "R") & (c("l_linestatus") == "F"))
    b = lines.join(orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
    b = b.groupBy("o_custkey").agg(F.sum(F.round(c("l_extendedprice") * 100).cast("long")).alias("v"))
    return [with_names(df, ["PLAYER_ID", "PLAYING_TIME"]) for df in (a, b)]


@query(f"WITH {_SOURCES} SELECT k AS \"PLAYER_ID\", v AS \"PLAYING_TIME\" FROM s")
def stacked_totals(spark, sf):
    return agg.stack_sum(_sources(spark, sf), "PLAYER_ID", "PLAYING_TIME")


@query(f"WITH {_SOURCES} SELECT c_custkey AS \"PLAYER_ID\", CAST(coalesce(v, 0) AS BIGINT) AS \"PLAYING_TIME\" FROM customer LEFT JOIN s ON c_custkey = k")
def roster_submission(spark, sf):
    roster = load(spark, sf, "customer").select(c("c_custkey").alias("PLAYER_ID"))
    a, b = _sources(spark, sf)
    return submission(roster, a, b).withColumn("PLAYING_TIME", c("PLAYING_TIME").cast("long"))


# --- files ------------------------------------------------------------------

_CY_SCHEMA = "custkey bigint, year int, n_orders bigint, urgent bigint, finished bigint, spend bigint, urgent_ratio double, grade string"


def _csv_source(spark, sf):
    cy = customer_years(spark, sf)
    grade = F.when(c("urgent") == 0, "").when(c("urgent") == 1, None).otherwise(F.lit("many"))
    return cy.withColumns({"urgent_ratio": ratio("finished", "urgent", "ieee"), "grade": grade})


@query(f"""WITH {CY} SELECT cy.*, CASE WHEN urgent > 0 THEN CAST(finished AS DOUBLE) / urgent END AS urgent_ratio,
  urgent = 0 AND finished > 0 AS was_infinite, CASE WHEN urgent > 1 THEN 'many' END AS grade FROM cy""")
def csv_roundtrip(spark, sf):
    path = write(_csv_source(spark, sf), scratch_path(spark, "csv"), "csv")
    back = cut_lineage(read_csv(spark, path, _CY_SCHEMA))
    remove(spark, path)
    return back.withColumns({"was_infinite": is_infinite("urgent_ratio"), "urgent_ratio": finite_or_null("urgent_ratio")})


def _guessed(spark, sf, index: bool):
    """The panel as another tool writes it: without types, infinity in lower case, perhaps a column of row numbers."""
    source = _csv_source(spark, sf).select("custkey", "year", "urgent_ratio")
    lower = F.when(is_infinite("urgent_ratio"), "inf").otherwise(c("urgent_ratio").cast("string"))
    source = source.withColumn("urgent_ratio", lower)
    if index:
        source = source.select((c("custkey") * 10000 + c("year")).alias("X"), *source.columns)
    path = write(source, scratch_path(spark, "guessed"), "csv")
    back = cut_lineage(read_csv(spark, path, drop_index=index))
    remove(spark, path)
    back = back.withColumns({"was_infinite": is_infinite("urgent_ratio"), "urgent_ratio": finite_or_null("urgent_ratio")})
    return back.withColumn("custkey", c("custkey").cast("long"))


_GUESSED = f"""WITH {CY} SELECT custkey, year, CASE WHEN urgent > 0 THEN CAST(finished AS DOUBLE) / urgent END AS urgent_ratio,
  urgent = 0 AND finished > 0 AS was_infinite FROM cy"""


@query(_GUESSED)
def csv_guessed_types(spark, sf):
    return _guessed(spark, sf, False)


@query(_GUESSED)
def csv_index_column(spark, sf):
    return _guessed(spark, sf, True)


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2")
def partitioned_roundtrip(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    path = write_partitioned(lines, scratch_path(spark, "lines"), ["l_returnflag", "l_linestatus"])
    back = spark.read.parquet(path).filter(c("l_returnflag") == "R")
    out = back.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(c("l_quantity").cast("long")).alias("quantity"))
    out = cut_lineage(out)
    remove(spark, path)
    return out


_DAMAGE = "CASE custkey % 10 WHEN 0 THEN 'short' WHEN 1 THEN 'long' WHEN 2 THEN 'text' WHEN 3 THEN 'date' ELSE 'good' END"


@query(f"""WITH {CY}, d AS (SELECT *, {_DAMAGE} AS damage FROM cy)
SELECT CASE damage WHEN 'short' THEN 'does not have 4 fields' WHEN 'long' THEN 'does not have 4 fields' WHEN 'text' THEN 'spend is no double: much'
         WHEN 'date' THEN 'day is no date: ' || year || '-13-01' END AS reason, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE damage WHEN 'good' THEN spend END) AS BIGINT) AS kept_spend,
  CAST(sum(CASE damage WHEN 'good' THEN NULL ELSE length(custkey || ',' || year || '-' || CASE damage WHEN 'date' THEN '13' ELSE '01' END || '-01'
    || CASE damage WHEN 'short' THEN '' WHEN 'text' THEN ',much' ELSE ',' || spend END || ',"a, b"' || CASE damage WHEN 'long' THEN ',more' ELSE '' END) END) AS BIGINT)
    AS rejected_chars
FROM d GROUP BY 1""")
def csv_quarantine(spark, sf):
    """Lines of the panel, some of them damaged: counted by the reason for which they are turned away."""
    cy = customer_years(spark, sf).withColumn("damage", F.expr(_DAMAGE))
    when = lambda kind, value, other="": F.when(c("damage") == kind, value).otherwise(other)
    line = F.concat(
        c("custkey"), F.lit(","), c("year"), F.lit("-"), when("date", "13", F.lit("01")), F.lit("-01"),
        when("short", F.lit(""), when("text", F.lit(",much"), F.concat(F.lit(","), c("spend")))), F.lit(',"a, b"'), when("long", F.lit(",more")),
    )
    path = scratch_path(spark, "damaged")
    cy.select(line.alias("value")).write.text(path)
    checked = cut_lineage(read_checked(spark, path, "custkey bigint, day date, spend double, note string"))
    remove(spark, path)
    good = kept(checked).agg(F.lit(None).cast("string").alias("reason"), F.count(F.lit(1)).alias("n"), F.sum("spend").cast("long").alias("kept_spend"))
    bad = rejected(checked).groupBy(c("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("_line")).alias("rejected_chars"))
    return good.unionByName(bad, allowMissingColumns=True)


@query(f"""WITH {CY}, {_TWO}, {_ACTUAL},
m AS ({' UNION ALL '.join(f"""SELECT '{s}' AS stat, CAST({s}_1999 AS DOUBLE) AS p, CAST({s}_2000 AS DOUBLE) AS l, CAST(y_{s} AS DOUBLE) AS y,
  in_1999 = 1 AND in_2000 = 1 AS b FROM jj""" for s in STATS)}),
t AS (SELECT stat, sum(p * p) FILTER (b) AS pp, sum(l * l) FILTER (b) AS ll, sum(p * l) FILTER (b) AS pl, sum(p * y) FILTER (b) AS py, sum(l * y) FILTER (b) AS ly,
        sum((l - y) * (l - y)) FILTER (b) AS dl, sum((l - p) * (l - y)) FILTER (b) AS dpl, sum((l - p) * (l - p)) FILTER (b) AS dp FROM m GROUP BY stat),
w AS (SELECT 'free' AS rule, stat, (py * ll - ly * pl) / (pp * ll - pl * pl) AS w1, (ly * pp - py * pl) / (pp * ll - pl * pl) AS w2 FROM t
      UNION ALL SELECT 'sum_to_one', stat, dpl / dp, 1 - dpl / dp FROM t)
SELECT rule, stat, round(any_value(w1), 6) AS w_prev, round(any_value(w2), 6) AS w_last,
  round(sqrt(avg(CASE WHEN b THEN (w1 * p + w2 * l - y) * (w1 * p + w2 * l - y) ELSE (l - y) * (l - y) END)), 3) AS rmse
FROM m JOIN w USING (stat) GROUP BY rule, stat""")
def optimal_weight_pairs(spark, sf):
    """The exact optimum that the grid of ``backtest_grid`` comes near to."""
    panel = customer_years(spark, sf, YEARS)
    rules = {"free": False, "sum_to_one": True}
    parts = [
        projection.optimal_weights(panel, "custkey", "year", STATS, YEARS[:2], YEARS[2], one).withColumn("rule", F.lit(rule))
        for rule, one in rules.items()
    ]
    out = joins.union_all(*parts)
    return out.select("rule", "stat", F.round("w_prev", 6).alias("w_prev"), F.round("w_last", 6).alias("w_last"), F.round("rmse", 3).alias("rmse"))
