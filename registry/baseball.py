"""The forecast's own operators on the derived pitch log."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallyfold.operators.aggregate import dedupe_first, group_sizes
from tallyfold.operators.joins import role_join
from tallyfold.operators.projection import backtest_weights, best_weights, history_class
from tallyfold.operators.reshape import pivot_wide
from tallyfold.operators.windows import surrogate_key
from tallyfold.plans import codes
from tallyfold.plans.hitters import (
    batter_lines as lines_of_batters,
    batter_seasons as seasons_of_batters,
    clean_events,
    complete_hitters,
    decay_weighted,
    next_season_table,
    lineup_spots as spots_of_batters,
    project_hitters,
    with_age,
)
from tallyfold.plans.pitchers import (
    batters_faced as faced,
    outs_recorded as outs_of,
    pitch_type_games as type_games,
    pitch_type_seasons as type_seasons,
    pitch_type_table as type_table,
    pitcher_lines as lines_of_pitchers,
    project_pitchers,
    reliever_rows as relievers,
    starter_rows as starters,
)
from tallyfold.session import cut_lineage, scratch_path
from tallyfold.sources import store_bucketed

from . import sql_lists as lists
from .base import game_rows, query, window_buckets
from .pitchlog import PEOPLE_SQL, PITCH_ORDER, PITCH_SQL, SEASONS, people, pitch_log

W = f"WITH {PITCH_SQL}"


def clean(spark, sf, seasons=None):
    return clean_events(pitch_log(spark, sf), seasons)


def _n(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


def _r(num: str, den: str) -> str:
    return f"round_even(CAST({num} AS DOUBLE) / nullif({den}, 0), 3)"


_RATES = f"""
    {_r('PA', 'games')} AS PA_PG, {_r('H', 'AB')} AS BA, {_r('H + BB + HBP', '(AB + BB + HBP + SF)')} AS OBP,
    {_r('TB', 'AB')} AS SLG, {_r('H - HR', '(AB - SO - HR + SF)')} AS BABIP, {_r('SO', 'PA')} AS K_perc,
    {_r('BB', 'PA')} AS BB_perc, {_r('HR', 'PA')} AS HR_perc, {_r('(H + BB) * TB', 'PA')} AS RC,
    {_r('AB - SO', 'AB')} AS Contact_perc, {_r('BB', 'SO')} AS BB_K_ratio, {_r('XBH', 'H')} AS XBH_perc"""

BATTER_CTE = f"""
bl0 AS (
  SELECT batter, year, CAST(count(DISTINCT game_date) AS BIGINT) AS games, CAST(count(*) AS BIGINT) AS PA,
    {_n(f"events IN {lists.HITS}")} AS H, {_n("events = 'single'")} AS Singles,
    {_n("events = 'double'")} AS Doubles, {_n("events = 'triple'")} AS Triples, {_n("events = 'home_run'")} AS HR,
    {_n("events = 'strikeout'")} AS SO, {_n("events = 'walk'")} AS BB, {_n("events = 'hit_by_pitch'")} AS HBP,
    {_n("events = 'sac_fly'")} AS SF, {_n("events = 'sac_bunt'")} AS SB, {_n("events = 'catcher_interf'")} AS CI,
    {_n(f"events IN {lists.AT_BATS}")} AS AB
  FROM p WHERE events IS NOT NULL GROUP BY batter, year),
bl1 AS (SELECT *, Doubles + Triples + HR AS XBH, Singles + 2 * Doubles + 3 * Triples + 4 * HR AS TB FROM bl0),
bl2 AS (SELECT *, {_RATES} FROM bl1),
bl AS (SELECT *, round_even(OBP + SLG, 3) AS OPS, round_even(SLG - BA, 3) AS ISO, {_r('RC', 'PA')} AS RC_per_PA FROM bl2)
"""

_SPOTS = [f"spot{i:02d}" for i in range(1, 10)]
SPOT_CTE = f"""
at_bats AS (
  SELECT batter, year, (rank() OVER (PARTITION BY game_pk, inning_topbot ORDER BY at_bat_number) - 1) % 9 + 1 AS spot
  FROM p WHERE length(events) > 2),
sp0 AS (
  SELECT batter, year, {', '.join(f"{_n(f'spot = {i}')} AS {s}" for i, s in enumerate(_SPOTS, 1))}
  FROM at_bats GROUP BY batter, year),
sp1 AS (SELECT *, {' + '.join(_SPOTS)} AS AB FROM sp0),
sp2 AS (SELECT *, {', '.join(f"CAST({s} AS DOUBLE) / AB * 100 AS {s}_per" for s in _SPOTS)} FROM sp1),
sp AS (SELECT *, (0e0 + {' + '.join(f"{i} * {s}_per" for i, s in enumerate(_SPOTS, 1))}) / 100 AS weighted_spot_avg FROM sp2)
"""

AGE_CTE = """
aged AS (
  SELECT bl.*, birthDate,
    CAST(year - year(birthDate) - CAST(400 + 1 < month(birthDate) * 100 + day(birthDate) AS INTEGER) AS BIGINT) AS age
  FROM bl LEFT JOIN people ON batter = player_mlb_id)
"""

HITTER_CTE = f"""{BATTER_CTE}, {SPOT_CTE}, {PEOPLE_SQL}, {AGE_CTE},
hit AS (
  SELECT aged.*, sp.weighted_spot_avg FROM aged LEFT JOIN sp ON aged.batter = sp.batter AND aged.year = sp.year)
"""
_RATE_NAMES = ["PA_PG", "BA", "OBP", "SLG", "OPS", "ISO", "BABIP", "K_perc", "BB_perc", "HR_perc", "RC",
               "Contact_perc", "BB_K_ratio", "RC_per_PA", "XBH_perc"]
COMPLETE_CTE = f"""{HITTER_CTE},
ch AS (SELECT * FROM hit WHERE birthDate IS NOT NULL AND {' AND '.join(f'{r} IS NOT NULL' for r in _RATE_NAMES)})
"""


@query(f"""{W} SELECT year, events, CAST(count(*) AS BIGINT) AS n, CAST(count(raw_events) AS BIGINT) AS n_raw
           FROM p GROUP BY year, events""")
def cleaned_event_counts(spark, sf):
    return clean(spark, sf).groupBy("year", "events").agg(
        F.count(F.lit(1)).alias("n"), F.count("raw_events").alias("n_raw")
    )


@query(f"{W}, {BATTER_CTE} SELECT * FROM bl")
def batter_lines(spark, sf):
    return lines_of_batters(clean(spark, sf))


@query(f"{W}, {BATTER_CTE}, {PEOPLE_SQL}, {AGE_CTE} SELECT batter, year, birthDate, age FROM aged")
def batter_ages(spark, sf):
    lines = lines_of_batters(clean(spark, sf)).select("batter", "year")
    return with_age(lines, people(spark, sf), "batter")


@query(f"{W}, {SPOT_CTE} SELECT * REPLACE (round(weighted_spot_avg, 9) AS weighted_spot_avg) FROM sp")
def lineup_spots(spark, sf):
    spots = spots_of_batters(clean(spark, sf), rows=game_rows(spark))
    return spots.withColumn("weighted_spot_avg", F.round("weighted_spot_avg", 9))


@query(f"{W}, {HITTER_CTE} SELECT * REPLACE (round(weighted_spot_avg, 9) AS weighted_spot_avg) FROM hit")
def batter_seasons(spark, sf):
    table = seasons_of_batters(clean(spark, sf), people(spark, sf), rows=game_rows(spark))
    return table.withColumn("weighted_spot_avg", F.round("weighted_spot_avg", 9))


_SUMMED = ["games", "PA", "H", "Singles", "Doubles", "Triples", "HR", "SO", "BB", "HBP", "SF", "SB", "CI", "AB", "XBH", "TB"]


def _future_sql(variant: str) -> str:
    w = "W" if variant == "faithful" else "1e0"
    rates = _RATES.replace(_r("TB", "AB") + " AS SLG", f"{_r('TB', f'(AB * {w})')} AS SLG")
    pa_pg = _r("PA", "games") if variant == "corrected" else "round_even(pa_pg_sum, 3)"
    rates = rates.replace(_r("PA", "games") + " AS PA_PG", f"{pa_pg} AS PA_PG")
    return f"""{W}, {BATTER_CTE},
    w AS (SELECT *, CASE year WHEN {SEASONS[0]} THEN 0.1 WHEN {SEASONS[1]} THEN 0.3 WHEN {SEASONS[2]} THEN 0.6 END AS weight FROM bl),
    f0 AS (SELECT batter, CAST(sum(weight) AS DOUBLE) AS W, CAST(sum(CAST(PA_PG AS DECIMAL(18,3)) * weight) AS DOUBLE) AS pa_pg_sum, {', '.join(f'CAST(sum({c} * weight) AS DOUBLE) AS {c}' for c in _SUMMED)}
           FROM w WHERE weight IS NOT NULL GROUP BY batter),
    f1 AS (SELECT batter, W, {', '.join(_SUMMED)}, {rates} FROM f0),
    f2 AS (SELECT *, round_even(OBP * {w} + SLG * {w}, 3) AS OPS, round_even(SLG * {w} - BA * {w}, 3) AS ISO,
                  {_r('RC', 'PA')} AS RC_per_PA FROM f1)
    SELECT batter, {', '.join(_SUMMED)}, {', '.join(_RATE_NAMES)} FROM f2"""


@query(f"""{_future_sql('corrected').replace('    SELECT batter, ', f'    , {PEOPLE_SQL} SELECT batter, ')}""".replace(
    " FROM f2", f""", {SEASONS[-1] + 1} AS year, birthDate,
      CAST({SEASONS[-1] + 1} - year(birthDate) - CAST(401 < month(birthDate) * 100 + day(birthDate) AS INTEGER) AS BIGINT) AS age
      FROM f2 LEFT JOIN people ON batter = player_mlb_id"""))
def future_batters_aged(spark, sf):
    return next_season_table(lines_of_batters(clean(spark, sf, SEASONS)), people(spark, sf), SEASONS)


def _half_up(sql: str) -> str:
    return re.sub(r"round_even\(", "round(", sql)


@query(_half_up(f"{W}, {BATTER_CTE} SELECT * FROM bl"))
def batter_lines_half_up(spark, sf):
    return lines_of_batters(clean(spark, sf), rounding="half_up")


@query(f"""{W}, {PEOPLE_SQL}, {AGE_CTE.replace('SELECT bl.*', 'SELECT DISTINCT batter, year').replace('FROM bl ', "FROM (SELECT DISTINCT batter, year FROM p WHERE events IS NOT NULL) bl ")}
           SELECT * FROM aged""")
def ages_from_text_dates(spark, sf):
    # birth dates as text, as a file would bring them
    who = people(spark, sf).withColumn("birthDate", F.date_format("birthDate", "yyyy-MM-dd"))
    lines = clean(spark, sf).filter(F.col("events").isNotNull()).select("batter", "year").distinct()
    return with_age(lines, who, "batter")


def _future(spark, sf, variant):
    return decay_weighted(lines_of_batters(clean(spark, sf, SEASONS)), SEASONS, variant=variant)


@query(_future_sql("corrected"))
def future_batters(spark, sf):
    return _future(spark, sf, "corrected")


@query(_future_sql("faithful"))
def future_batters_faithful(spark, sf):
    return _future(spark, sf, "faithful")


# --- pitchers ---------------------------------------------------------------

_COUNTERS = {
    n: f"{src} = " + (f"'{v}'" if isinstance(v, str) else str(v)) for n, (src, v) in codes.GAME_COUNTERS.items()
}


def _games_sql(launch_speed: str = "launch_speed") -> str:
    means = codes.GAME_MEANS | {"launch_speed": launch_speed}
    return f"""
    pg0 AS (SELECT pitcher, year, game_pk, pitch_type, {', '.join(f'avg({s}) AS {n}_m' for n, s in means.items())},
            {', '.join(f'{_n(cond)} AS {n}' for n, cond in _COUNTERS.items())}
            FROM p GROUP BY pitcher, year, game_pk, pitch_type),
    pg AS (SELECT *, {' + '.join(codes.PITCHES_THROWN)} AS pitches_thrown FROM pg0)"""


_SUMS = [*codes.GAME_COUNTERS, "pitches_thrown"]
_SEASON_SQL = f"""
ps AS (SELECT pitcher, year, pitch_type, {', '.join(f'round(avg({n}_m), 9) AS {n}' for n in codes.SEASON_MEANS)},
       {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in _SUMS)} FROM pg GROUP BY pitcher, year, pitch_type)"""
FACED_CTE = """
bf AS (SELECT pitcher, year, role_key, CAST(sum(m) AS BIGINT) AS batters_faced
       FROM (SELECT pitcher, year, role_key, game_pk, max(pitcher_at_bat_number) AS m FROM p GROUP BY ALL) GROUP BY pitcher, year, role_key)"""


def _settle(df, cols):
    return df.withColumns({n: F.round(n, 9) for n in cols})


@query(f"""{W}, {_games_sql()} SELECT pitcher, year, game_pk, pitch_type, {', '.join(f'{n}_m AS {n}' for n in codes.GAME_MEANS)},
           {', '.join(_SUMS)} FROM pg""")
def pitch_type_games(spark, sf):
    return type_games(clean(spark, sf))


def _strict(name: str) -> str:
    source = codes.GAME_COUNTERS[name][0]
    return f"CASE WHEN count({source}) = count(*) THEN {_n(_COUNTERS[name])} END"


@query(f"""{W} SELECT pitcher, year, game_pk, pitch_type, {', '.join(f'{_strict(n)} AS {n}' for n in codes.GAME_COUNTERS)},
           {' + '.join(_strict(n) for n in codes.PITCHES_THROWN)} AS pitches_thrown
           FROM p GROUP BY pitcher, year, game_pk, pitch_type""")
def pitch_type_games_strict(spark, sf):
    return type_games(clean(spark, sf), strict_null=True).select("pitcher", "year", "game_pk", "pitch_type", *_SUMS)


@query(f"{W}, {_games_sql()}, {_SEASON_SQL} SELECT * FROM ps")
def pitch_type_seasons(spark, sf):
    return _settle(type_seasons(type_games(clean(spark, sf))), codes.SEASON_MEANS)


@query(f"{W}, {_games_sql('launch_angle')}, {_SEASON_SQL} SELECT * FROM ps")
def pitch_type_seasons_launch_angle(spark, sf):
    return _settle(type_seasons(type_games(clean(spark, sf), "launch_angle")), codes.SEASON_MEANS)


@query(f"{W}, {FACED_CTE} SELECT * FROM bf")
def batters_faced(spark, sf):
    return faced(clean(spark, sf))


@query(f"""{W}, {_games_sql()}, {_SEASON_SQL}, {FACED_CTE}
           SELECT ps.*, role_key, batters_faced FROM ps LEFT JOIN bf ON ps.pitcher = bf.pitcher AND ps.year = bf.year""")
def pitch_type_table(spark, sf):
    return _settle(type_table(clean(spark, sf)), codes.SEASON_MEANS)


def _outs_cte(event: str = "raw_events", missing: str = "keep") -> str:
    otherwise = "out2" if missing == "keep" else f"CASE WHEN {event} IS NOT NULL THEN out2 END"
    return f"""
    o0 AS (SELECT *, row_number() OVER w AS nth, lag(outs_when_up) OVER w AS before,
                  max(pitch_number_appearance) OVER (PARTITION BY pitcher, game_pk) AS final
           FROM p WINDOW w AS (PARTITION BY pitcher, game_pk ORDER BY {', '.join(PITCH_ORDER)})),
    o1 AS (SELECT *, CASE WHEN nth = 1 THEN 0 ELSE outs_when_up - before END AS out1 FROM o0),
    o2 AS (SELECT *, CASE out1 WHEN -1 THEN 2 WHEN -2 THEN 1 ELSE out1 END AS out2 FROM o1),
    o AS (SELECT *, CASE WHEN pitch_number_appearance <> final THEN out2
                    WHEN {event} IN {lists.SINGLE_OUTS} THEN 1
                    WHEN {event} IN {lists.DOUBLE_OUTS} THEN 2
                    WHEN {event} = 'triple_play' THEN 3 ELSE {otherwise} END AS out_diff FROM o2)"""


def _line_cte(event: str = "raw_events", missing: str = "keep") -> str:
    nine = ", ".join(
        f"CASE WHEN IP = 0 THEN CASE WHEN {s} = 0 THEN 'nan'::DOUBLE WHEN {s} > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE {s} / IP END * 9 AS {n}"
        for n, s in {"ERA": "ER", "H9": "H", "HR9": "HR", "BB9": "BB", "SO9": "SO"}.items()
    )
    ieee = lambda a, b: f"CASE WHEN {b} = 0 THEN CASE WHEN {a} = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE CAST({a} AS DOUBLE) / {b} END"
    return f"""{_outs_cte(event, missing)}, {FACED_CTE},
    l0 AS (SELECT pitcher, role_key, year, coalesce(sum(out_diff), 0) AS outs,
             {_n(f"events IN {lists.HITS_AND_WALKS}")} AS on_base,
             {_n(f"events IN {lists.HITS}")} AS H, {_n("events = 'home_run'")} AS HR,
             CAST(sum(post_bat_score - bat_score) AS BIGINT) AS ER,
             {_n(f"events IN {lists.PITCHER_STRIKEOUTS}")} AS SO, {_n("events = 'walk'")} AS BB,
             {_n("events = 'hit_by_pitch'")} AS HBP
           FROM o GROUP BY pitcher, role_key, year),
    l1 AS (SELECT * EXCLUDE (outs, on_base), CAST(outs AS DOUBLE) / 3 AS IP, {ieee('on_base', '(CAST(outs AS DOUBLE) / 3)')} AS WHIP,
             {ieee('SO', 'BB')} AS SOBBratio FROM l0),
    l2 AS (SELECT *, {nine} FROM l1),
    pl AS (SELECT l2.*, batters_faced FROM l2 LEFT JOIN bf ON l2.pitcher = bf.pitcher AND l2.role_key = bf.role_key AND l2.year = bf.year)"""


_PITCHER_RATES = ["IP", "WHIP", "SOBBratio", "ERA", "H9", "HR9", "BB9", "SO9"]
# infinities and NaN are compared as text, finite values as numbers
_SPELLED = ", ".join(
    f"CASE WHEN isfinite({r}) THEN {r} END AS {r}, CASE WHEN isnan({r}) THEN 'nan' WHEN isinf({r}) THEN 'inf' ELSE 'finite' END AS {r}_kind"
    for r in _PITCHER_RATES
)


def _spell(df, rates=tuple(_PITCHER_RATES)):
    from tallyfold.functions import finite_or_null, is_infinite

    kinds = {f"{r}_kind": F.when(F.isnan(r), "nan").when(is_infinite(r), "inf").otherwise("finite") for r in rates}
    return df.withColumns(kinds).withColumns({r: finite_or_null(r) for r in rates})


@query(f"""{W}, {_outs_cte()} SELECT pitcher, game_pk, role_key, CAST(count(*) AS BIGINT) AS pitches,
           CAST(sum(out_diff) AS BIGINT) AS outs, CAST(max(out_diff) AS INTEGER) AS most FROM o GROUP BY pitcher, game_pk, role_key""")
def outs_recorded(spark, sf):
    outs = outs_of(clean(spark, sf), order=PITCH_ORDER, rows=game_rows(spark))
    return outs.groupBy("pitcher", "game_pk", "role_key").agg(
        F.count(F.lit(1)).alias("pitches"), F.sum("out_diff").alias("outs"), F.max("out_diff").alias("most")
    )


@query(f"""{W}, {_outs_cte()}, {_games_sql()},
  t AS (SELECT pitcher, game_pk, CAST(count(*) AS BIGINT) AS pitches, CAST(sum(out_diff) AS BIGINT) AS outs FROM o GROUP BY pitcher, game_pk),
  k AS (SELECT pitcher, game_pk, CAST(count(*) AS BIGINT) AS kinds, CAST(sum(pitches_thrown) AS BIGINT) AS thrown FROM pg GROUP BY pitcher, game_pk)
  SELECT * FROM t JOIN k USING (pitcher, game_pk)""")
def stored_log_games(spark, sf):
    """Outs and pitch types per game from a log stored by game: the scans need no shuffle."""
    path = scratch_path(spark, "pitch-log")
    # stored as it comes, cleaned as it is read: what cleaning adds is neither shuffled nor written
    stored = store_bucketed(pitch_log(spark, sf), path, ["pitcher", "game_pk"], window_buckets(spark), PITCH_ORDER)
    log = clean_events(stored)
    outs = outs_of(log, order=PITCH_ORDER, rows=game_rows(spark)).groupBy("pitcher", "game_pk")
    kinds = type_games(log, gathered=True).groupBy("pitcher", "game_pk")
    per_game = outs.agg(F.count(F.lit(1)).alias("pitches"), F.sum("out_diff").alias("outs"))
    return per_game.join(kinds.agg(F.count(F.lit(1)).alias("kinds"), F.sum("pitches_thrown").alias("thrown")), ["pitcher", "game_pk"])


_LINE_COLS = "pitcher, role_key, year, H, HR, ER, SO, BB, HBP, batters_faced"


@query(f"{W}, {_line_cte()} SELECT {_LINE_COLS}, {_SPELLED} FROM pl")
def pitcher_lines(spark, sf):
    return _spell(lines_of_pitchers(clean(spark, sf), order=PITCH_ORDER, rows=game_rows(spark)))


@query(f"{W}, {_line_cte('events', 'null')} SELECT {_LINE_COLS}, {_SPELLED} FROM pl")
def pitcher_lines_faithful(spark, sf):
    return _spell(lines_of_pitchers(clean(spark, sf), "events", "null", order=PITCH_ORDER, rows=game_rows(spark)))


def _imputed(name: str, cap: str) -> str:
    return f"CASE WHEN isinf({name}) THEN {cap} WHEN {name} IS NULL OR isnan({name}) THEN 0e0 ELSE {name} END AS {name}"


_RELIEVER_COLS = "pitcher, year, H, HR, ER, SO, BB, HBP, batters_faced"


@query(f"""{W}, {_line_cte()} SELECT {_RELIEVER_COLS}, {_imputed('SOBBratio', '21e0')}, {_imputed('WHIP', '12e0')}
           FROM pl WHERE role_key = 'RP'""")
def reliever_rows(spark, sf):
    rows = relievers(lines_of_pitchers(clean(spark, sf), order=PITCH_ORDER, rows=game_rows(spark)))
    return rows.select(*_RELIEVER_COLS.split(", "), "SOBBratio", "WHIP")


@query(f"""{W}, {_line_cte()}, rp AS (SELECT * FROM pl WHERE role_key = 'RP')
           SELECT {_RELIEVER_COLS}, {_imputed('SOBBratio', '(SELECT max(SOBBratio) FROM rp WHERE isfinite(SOBBratio))')},
                  {_imputed('WHIP', '(SELECT max(WHIP) FROM rp WHERE isfinite(WHIP))')} FROM rp""")
def reliever_rows_capped_by_data(spark, sf):
    rows = relievers(cut_lineage(lines_of_pitchers(clean(spark, sf), order=PITCH_ORDER, rows=game_rows(spark))), cap="max")
    return rows.select(*_RELIEVER_COLS.split(", "), "SOBBratio", "WHIP")


@query(f"""{W}, {_line_cte()} SELECT pitcher, year, {', '.join(lists.PITCHER_STATS)}, batters_faced FROM pl
           WHERE role_key = 'SP' AND isfinite(WHIP) AND isfinite(SOBBratio)""")
def starter_rows(spark, sf):
    rows = starters(lines_of_pitchers(clean(spark, sf), order=PITCH_ORDER, rows=game_rows(spark)))
    return rows.select("pitcher", "year", *codes.PITCHER_STATS, "batters_faced")


# --- projections ------------------------------------------------------------


def _wide_cte(source: str, key: str, period: str, stats, periods, name: str = "wide") -> str:
    cols = [f"max(CASE WHEN {period} = {y} THEN {s} END) AS {s}_{y}" for y in periods for s in stats]
    flags = [f"CAST(count(*) FILTER (WHERE {period} = {y}) > 0 AS INTEGER) AS in_{y}" for y in periods]
    years = ", ".join(map(str, periods))
    return f"{name} AS (SELECT {key}, {', '.join(cols + flags)} FROM {source} WHERE {period} IN ({years}) GROUP BY {key})"


def _blend_sql(stat: str, weights, periods) -> str:
    (w1, w2, w3), (v1, v2) = weights
    a, b, c = periods
    return f"""CASE WHEN in_{a} = 1 AND in_{b} = 1 AND in_{c} = 1 THEN {w1}e0 * {stat}_{a} + {w2}e0 * {stat}_{b} + {w3}e0 * {stat}_{c}
      WHEN in_{a} = 0 AND in_{b} = 1 AND in_{c} = 1 THEN {v1}e0 * {stat}_{b} + {v2}e0 * {stat}_{c}
      ELSE CAST({stat}_{c} AS DOUBLE) END"""


_HW, _PW = lists.HITTER_WEIGHTS, {s: lists.COUNTING for s in lists.PITCHER_STATS}
_TARGET = SEASONS[-1] + 1


@query(f"""{W}, {COMPLETE_CTE}, {_wide_cte('ch', 'batter', 'year', _HW, SEASONS)},
       pr AS (SELECT batter, {', '.join(f'{_blend_sql(s, w, SEASONS)} AS {s}' for s, w in _HW.items())} FROM wide)
       SELECT batter, {', '.join(f'round({s}, 9) AS {s}' for s in _HW)},
         CAST({_TARGET} - year(birthDate) - CAST(401 < month(birthDate) * 100 + day(birthDate) AS INTEGER) AS BIGINT) AS age
       FROM pr JOIN people ON batter = player_mlb_id WHERE SF IS NOT NULL""")
def hitter_projection(spark, sf):
    who = people(spark, sf)
    hitters = complete_hitters(seasons_of_batters(clean(spark, sf, SEASONS), who, rows=game_rows(spark)))
    return _settle(project_hitters(hitters, who, SEASONS), list(_HW))


def _projection_sql(role: str) -> str:
    return f"""{W}, {_line_cte()},
       cp AS (SELECT * FROM pl WHERE role_key = '{role}' AND isfinite(WHIP) AND isfinite(SOBBratio) AND isfinite(ERA)
                AND isfinite(H9) AND isfinite(HR9) AND isfinite(BB9) AND isfinite(SO9)),
       {_wide_cte('cp', 'pitcher', 'year', _PW, SEASONS)}
       SELECT pitcher, {', '.join(f'round({_blend_sql(s, w, SEASONS)}, 9) AS {s}' for s, w in _PW.items())} FROM wide"""


@query(_projection_sql("SP"))
def starter_projection(spark, sf):
    lines = lines_of_pitchers(clean(spark, sf, SEASONS), order=PITCH_ORDER, rows=game_rows(spark))
    return _settle(project_pitchers(lines, "SP", SEASONS), list(_PW))


@query(_projection_sql("RP"))
def reliever_projection(spark, sf):
    lines = lines_of_pitchers(clean(spark, sf, SEASONS), order=PITCH_ORDER, rows=game_rows(spark))
    return _settle(project_pitchers(lines, "RP", SEASONS), list(_PW))


@query(f"""{W}, {COMPLETE_CTE}, {_wide_cte('ch', 'batter', 'year', ['PA'], SEASONS)}
       SELECT {', '.join(f'in_{y}' for y in SEASONS)},
         CASE WHEN in_{SEASONS[0]} + in_{SEASONS[1]} + in_{SEASONS[2]} = 3 THEN 1
              WHEN in_{SEASONS[0]} = 0 AND in_{SEASONS[1]} = 1 AND in_{SEASONS[2]} = 1 THEN 2
              WHEN in_{SEASONS[0]} = 0 AND in_{SEASONS[1]} = 0 AND in_{SEASONS[2]} = 1 THEN 3 ELSE 4 END AS year_ind,
         CAST(count(*) AS BIGINT) AS n FROM wide GROUP BY ALL""")
def hitter_history(spark, sf):
    hitters = complete_hitters(seasons_of_batters(clean(spark, sf, SEASONS), people(spark, sf), rows=game_rows(spark)))
    wide = pivot_wide(hitters, "batter", "year", ["PA"], SEASONS).withColumn("year_ind", history_class(SEASONS))
    return group_sizes(wide, [*[f"in_{y}" for y in SEASONS], "year_ind"])


def _backtest_sql(source_cte: str, source: str, key: str, stats, extra: str = "") -> str:
    a, b, t = SEASONS
    parts = []
    for w1, w2 in codes.WEIGHT_GRID:
        for s in stats:
            pred = f"CASE WHEN in_{a} = 1 AND in_{b} = 1 THEN {w1}e0 * {s}_{a} + {w2}e0 * {s}_{b} ELSE {s}_{b} END"
            parts.append(f"SELECT '{s}' AS stat, {w1}e0 AS w_prev, {w2}e0 AS w_last, round(sqrt(avg(({pred} - y_{s}) * ({pred} - y_{s}))), 6) AS rmse FROM jj")
    return f"""{W}, {source_cte}, {_wide_cte(source, key, 'year', stats, (a, b))},
      act AS (SELECT {key} AS k, {', '.join(f'{s} AS y_{s}' for s in stats)} FROM {source} WHERE year = {t}),
      jj AS (SELECT * FROM wide JOIN act ON {key} = k),
      metrics AS ({' UNION ALL '.join(parts)}) {extra or 'SELECT * FROM metrics'}"""


def _hitter_backtest(spark, sf):
    hitters = complete_hitters(seasons_of_batters(clean(spark, sf, SEASONS), people(spark, sf), rows=game_rows(spark)))
    out = backtest_weights(hitters, "batter", "year", list(_HW), SEASONS[:2], SEASONS[2], codes.WEIGHT_GRID)
    return out.withColumn("rmse", F.round("rmse", 6))


_BEST = "SELECT stat, w_prev, w_last, rmse FROM metrics QUALIFY row_number() OVER (PARTITION BY stat ORDER BY rmse, w_prev) = 1"


@query(_backtest_sql(COMPLETE_CTE, "ch", "batter", list(_HW)))
def hitter_weight_backtest(spark, sf):
    return _hitter_backtest(spark, sf)


@query(_backtest_sql(COMPLETE_CTE, "ch", "batter", list(_HW), _BEST))
def hitter_best_weights(spark, sf):
    return best_weights(_hitter_backtest(spark, sf))


_FIRST_ROLE = f"""{_line_cte()},
  cp AS (SELECT * FROM pl WHERE isfinite(WHIP) AND isfinite(SOBBratio) AND isfinite(ERA) AND isfinite(H9)
         AND isfinite(HR9) AND isfinite(BB9) AND isfinite(SO9)
         QUALIFY row_number() OVER (PARTITION BY pitcher, year ORDER BY role_key) = 1)"""


@query(_backtest_sql(_FIRST_ROLE, "cp", "pitcher", lists.PITCHER_STATS))
def pitcher_weight_backtest(spark, sf):
    from tallyfold.operators.cleaning import drop_incomplete, inf_to_null

    lines = drop_incomplete(inf_to_null(lines_of_pitchers(clean(spark, sf, SEASONS), order=PITCH_ORDER, rows=game_rows(spark))))
    one_role = dedupe_first(lines, ["pitcher", "year"], ["role_key"])
    out = backtest_weights(one_role, "pitcher", "year", codes.PITCHER_STATS, SEASONS[:2], SEASONS[2], codes.WEIGHT_GRID)
    return out.withColumn("rmse", F.round("rmse", 6))


@query(f"""{W}, t AS (SELECT home_team AS team, 'team_' || row_number() OVER (ORDER BY home_team) AS team_id
                      FROM (SELECT DISTINCT home_team FROM p))
       SELECT h.team_id AS team_id_home, a.team_id AS team_id_away, CAST(count(*) AS BIGINT) AS pitches
       FROM p LEFT JOIN t h ON home_team = h.team LEFT JOIN t a ON away_team = a.team GROUP BY ALL""")
def team_roles(spark, sf):
    # pitches per pair of teams first: the dimension then meets pairs, not pitches
    pairs = group_sizes(pitch_log(spark, sf), ["home_team", "away_team"], "pitches")
    teams = surrogate_key(pairs.select(F.col("home_team").alias("team")).distinct(), ["team"], "team", "team_id", game_rows(spark))
    both = role_join(pairs, teams, "team", {"home_team": "_home", "away_team": "_away"})
    return both.groupBy("team_id_home", "team_id_away").agg(F.sum("pitches").alias("pitches"))
