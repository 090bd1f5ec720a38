"""A pitch log derived from the test tables.

Every line item is one pitch: supplier = pitcher, customer of the order =
batter, (pair of suppliers, quarter) = game. The derivation is a fixed formula
of the row, so it grows with the tables and SQL can repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.plans import codes
from tallyfold.sources import load

from . import sql_lists as lists

SEASONS = (1999, 2000, 2001)
PITCH_ORDER = ("pitch_number_appearance", "tie_part", "tie_ship")

# --- fixed values: event names
EVENTS = [
    "single", "field_out", "", "double", "strikeout", "walk", None, "home_run", "field_out",
    "sac_fly", "triple", "strikeout", "caught_stealing_2b", "grounded_into_double_play",
    "hit_by_pitch", "single", "wild_pitch", "force_out", "catcher_interf",
    "strikeout_double_play", "field_error", "walk", "pickoff_1b", "fielders_choice", "other_out",
    "fielders_choice_out", "double_play", "sac_bunt", "stolen_base_2b", "sac_fly_double_play",
    "triple_play", "sac_bunt_double_play", "single", "caught_stealing_home", "field_out", "double",
    "passed_ball", "strikeout", "game_advisory", "single",
]
MEASURES = [m for m in codes.GAME_MEANS.values() if not m.endswith("indicator")]


def _list(values) -> str:
    return "array(" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + ")"


# bit operations on the keys: cheap per row, whole numbers, so sums are exact
_MEASURES = [
    f"IF(l_linenumber = {i % 7 + 1}, NULL, CAST((l_partkey ^ (l_orderkey >> {i % 5})) & {2 ** (4 + i % 4) - 1} AS DOUBLE)) AS {m}"
    for i, m in enumerate(MEASURES)
]


def pitch_log(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "CAST(o_orderdate AS DATE) AS d")
    orders = orders.selectExpr("*", "(year(d) - 1995) * 4 + quarter(d) - 1 AS q")
    return load(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "d AS game_date",
        "l_suppkey div 2 * 1000 + q AS game_pk",
        "o_custkey AS batter",
        "l_suppkey AS pitcher",
        f"element_at({_list(EVENTS)}, CAST(l_partkey % {len(EVENTS)} AS INT) + 1) AS events",
        "concat('T', l_suppkey div 2 % 30) AS home_team",
        "concat('T', (l_suppkey div 2 + q) % 30) AS away_team",
        "IF(l_suppkey % 2 = 0, 'Top', 'Bot') AS inning_topbot",
        "l_orderkey AS at_bat_number",
        "l_orderkey * 8 + l_linenumber AS pitch_number_appearance",
        "l_partkey AS tie_part",
        "CAST(l_shipdate AS DATE) AS tie_ship",
        "l_linenumber + CAST(l_quantity AS INT) AS pitcher_at_bat_number",
        "CAST(l_quantity AS INT) % 3 AS outs_when_up",
        "CAST(round(l_discount * 100) AS INT) AS bat_score",
        "CAST(round(l_discount * 100) AS INT) + CAST(round(l_tax * 100) AS INT) % 3 AS post_bat_score",
        "IF(l_linestatus = 'F', 'SP', 'RP') AS role_key",
        "IF(l_linestatus = 'F', 1D, 0D) AS sp_indicator",
        "IF(l_linestatus = 'F', 0D, 1D) AS rp_indicator",
        "l_returnflag AS pitch_type",
        "element_at(array('S', 'B', 'X'), l_linenumber % 3 + 1) AS type",
        "element_at(array('line_drive', 'fly_ball', 'ground_ball', 'popup', NULL), CAST(l_partkey % 5 AS INT) + 1) AS bb_type",
        "IF(l_partkey % 8 BETWEEN 1 AND 6, CAST(l_partkey % 8 AS INT), NULL) AS launch_speed_angle",
        *_MEASURES,
    )


def people(spark: SparkSession, sf: str) -> DataFrame:
    born = F.date_add(F.lit("1960-01-01").cast("date"), (F.col("c_custkey") * 7919 % 14000).cast("int"))
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("player_mlb_id"), born.alias("birthDate"))


def _text(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_MEASURE_SQL = ",\n".join(
    f"CASE WHEN l_linenumber <> {i % 7 + 1} THEN CAST(xor(l_partkey, l_orderkey >> {i % 5}) & {2 ** (4 + i % 4) - 1} AS DOUBLE) END AS {m}"
    for i, m in enumerate(MEASURES)
)

PITCH_SQL = f"""
j AS (
  SELECT *, CAST(o_orderdate AS DATE) AS d, l_suppkey // 2 AS pair,
         (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (
  SELECT d AS game_date, CAST(year(d) AS INTEGER) AS year, CAST(pair * 1000 + q AS BIGINT) AS game_pk,
    o_custkey AS batter, l_suppkey AS pitcher,
    ({_text(EVENTS)})[l_partkey % {len(EVENTS)} + 1] AS source_event,
    nullif(source_event, '') AS raw_events,
    CASE WHEN nullif(source_event, '') NOT IN {lists.NOT_PLATE_APPEARANCE} THEN source_event END AS events,
    'T' || CAST(pair % 30 AS VARCHAR) AS home_team, 'T' || CAST((pair + q) % 30 AS VARCHAR) AS away_team,
    CASE WHEN l_suppkey % 2 = 0 THEN 'Top' ELSE 'Bot' END AS inning_topbot,
    l_orderkey AS at_bat_number, l_orderkey * 8 + l_linenumber AS pitch_number_appearance,
    l_partkey AS tie_part, CAST(l_shipdate AS DATE) AS tie_ship,
    l_linenumber + CAST(l_quantity AS INTEGER) AS pitcher_at_bat_number,
    CAST(l_quantity AS INTEGER) % 3 AS outs_when_up,
    CAST(round(l_discount * 100) AS INTEGER) AS bat_score,
    CAST(round(l_discount * 100) AS INTEGER) + CAST(round(l_tax * 100) AS INTEGER) % 3 AS post_bat_score,
    CASE WHEN l_linestatus = 'F' THEN 'SP' ELSE 'RP' END AS role_key,
    CASE WHEN l_linestatus = 'F' THEN 1e0 ELSE 0e0 END AS sp_indicator,
    CASE WHEN l_linestatus = 'F' THEN 0e0 ELSE 1e0 END AS rp_indicator,
    l_returnflag AS pitch_type, (['S', 'B', 'X'])[l_linenumber % 3 + 1] AS type,
    (['line_drive', 'fly_ball', 'ground_ball', 'popup', NULL])[l_partkey % 5 + 1] AS bb_type,
    CASE WHEN l_partkey % 8 BETWEEN 1 AND 6 THEN CAST(l_partkey % 8 AS INTEGER) END AS launch_speed_angle,
    {_MEASURE_SQL}
  FROM j)
"""

PEOPLE_SQL = """
people AS (
  SELECT c_custkey AS player_mlb_id,
         CAST(DATE '1960-01-01' + CAST(c_custkey * 7919 % 14000 AS INTEGER) AS DATE) AS birthDate
  FROM customer)
"""
