"""The baseball configuration on hand-made rows."""

import datetime as dt
import math

import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from tallyfold.plans import codes
from tallyfold.plans.hitters import (
    batter_lines,
    batter_seasons,
    clean_events,
    complete_hitters,
    decay_weighted,
    lineup_spots,
    project_hitters,
    with_age,
)
from tallyfold.plans.pitchers import (
    batters_faced,
    outs_recorded,
    pitch_type_games,
    pitch_type_seasons,
    pitch_type_table,
    pitcher_lines,
    project_pitchers,
    reliever_rows,
    starter_rows,
)

D = dt.date
EVENTS = "game_date date, game_pk long, batter long, inning_topbot string, at_bat_number int, events string"


def batting(spark, events, batter=1, date=D(2021, 5, 1), game=1):
    return spark.createDataFrame([(date, game, batter, "Top", i, e) for i, e in enumerate(events, 1)], EVENTS)


def test_only_plate_appearances_remain(spark):
    df = clean_events(batting(spark, [None, "", *codes.NOT_PLATE_APPEARANCE, "single"]))
    rows = as_dicts(df, "at_bat_number")
    assert [r["events"] for r in rows] == [None] * 17 + ["single"]
    assert rows[2]["raw_events"] == "caught_stealing_3b" and rows[1]["raw_events"] is None


def test_batter_line(spark):
    day = ["single", "double", "triple", "home_run", "walk", "strikeout", "sac_fly"]
    other = ["sac_bunt", "strikeout_double_play", "hit_by_pitch", "field_out", "catcher_interf", "", "stolen_base_2b"]
    log = batting(spark, day).union(batting(spark, other, game=2))  # a double-header: one date
    row = as_dicts(batter_lines(clean_events(log)))[0]
    assert (row["batter"], row["year"], row["games"], row["PA"]) == (1, 2021, 1, 12)
    assert (row["H"], row["AB"], row["SO"], row["BB"], row["HBP"], row["SF"], row["SB"], row["CI"]) == (4, 7, 1, 1, 1, 1, 1, 1)
    assert (row["Singles"], row["Doubles"], row["Triples"], row["HR"], row["XBH"], row["TB"]) == (1, 1, 1, 1, 3, 10)
    assert (row["BA"], row["OBP"], row["SLG"]) == (0.571, 0.6, 1.429)
    assert (row["OPS"], row["ISO"]) == (2.029, 0.858)  # from the rounded parts
    assert row["BABIP"] == 0.5 and row["RC"] == 4.167 and row["RC_per_PA"] == 0.347
    assert (row["Contact_perc"], row["BB_K_ratio"], row["XBH_perc"], row["PA_PG"]) == (0.857, 1.0, 0.75, 12.0)
    assert len(row) == 34 - 1  # the season weight is not part of the line
    assert row["PA"] >= row["AB"] >= row["H"]


def test_zero_denominators(spark):
    walks = clean_events(batting(spark, ["walk", "walk"]))
    row = as_dicts(batter_lines(walks))[0]
    assert row["AB"] == 0 and row["BA"] is None and row["OPS"] is None and row["OBP"] == 1.0
    ieee = as_dicts(batter_lines(walks, on_zero="ieee"))[0]
    assert math.isnan(ieee["BA"]) and ieee["BB_K_ratio"] == math.inf


def test_age(spark):
    lines = spark.createDataFrame([(1, 2021), (2, 2021), (3, 2021), (4, 2021)], "batter long, year int")
    people = spark.createDataFrame([(1, "1990-04-01"), (2, "1990-04-02"), (3, "1992-02-29")], "player_mlb_id long, birthDate string")
    assert [r["age"] for r in as_dicts(with_age(lines, people, "batter"), "batter")] == [31, 30, 29, None]


@pytest.mark.parametrize("slices", [None, 5])
def test_lineup_spots(spark, slices):
    at_bats = [(D(2021, 5, 1), 1, (i - 1) % 9 + 1, "Top", i, "field_out") for i in range(1, 20)]
    at_bats += [(D(2021, 5, 1), 1, 99, "Bot", 3, "single")]
    got = as_dicts(lineup_spots(clean_events(spark.createDataFrame(at_bats, EVENTS)), slices=slices), "batter")
    assert [r["weighted_spot_avg"] for r in got] == [pytest.approx(i) for i in range(1, 10)] + [1.0]
    assert got[0]["spot01"] == 3 and got[0]["AB"] == 3 and got[0]["spot01_per"] == 100.0


def season_line(spark, rows):
    return spark.createDataFrame(
        [(b, y, *([n] * 16), float(n)) for b, y, n in rows],
        "batter long, year int, games long, PA long, H long, Singles long, Doubles long, Triples long, HR long, SO long,"
        " BB long, HBP long, SF long, SB long, CI long, AB long, XBH long, TB long, PA_PG double",
    )


def test_season_weights(spark):
    lines = season_line(spark, [(1, 2021, 10), (1, 2022, 10), (1, 2023, 10), (2, 2022, 10), (2, 2023, 10), (3, 2023, 10)])
    good = as_dicts(decay_weighted(lines, (2021, 2022, 2023)), "batter")
    plain = as_dicts(decay_weighted(lines, (2021, 2022, 2023), variant="faithful"), "batter")
    assert [r["PA"] for r in good] == [10.0, 9.0, 6.0] == [r["PA"] for r in plain]
    assert [r["SLG"] for r in good] == [1.0, 1.0, 1.0]
    assert [r["SLG"] for r in plain] == [1.0, 1.111, 1.667]
    assert [r["OBP"] for r in plain] == [0.75, 0.75, 0.75]
    assert [r["OPS"] for r in good] == [1.75] * 3
    assert [r["OPS"] for r in plain] == [1.75, 1.675, 1.45]
    assert [r["PA_PG"] for r in plain] == [10.0, 9.0, 6.0] and [r["PA_PG"] for r in good] == [1.0] * 3


# --- pitchers ---------------------------------------------------------------

PITCHES = (
    "game_date date, game_pk long, pitcher long, role_key string, pitch_number_appearance int, outs_when_up int,"
    " events string, pitcher_at_bat_number int, bat_score int, post_bat_score int"
)


def appearance(spark, outs, events=None, pitcher=1, game=1, role="SP"):
    events = events or [None] * len(outs)
    return spark.createDataFrame(
        [(D(2021, 5, 1), game, pitcher, role, i, o, e, i, 0, 1 if e == "home_run" else 0) for i, (o, e) in enumerate(zip(outs, events), 1)],
        PITCHES,
    )


def outs(df, **kw):
    return [r["out_diff"] for r in as_dicts(outs_recorded(clean_events(df), **kw), "pitch_number_appearance")]


@pytest.mark.parametrize("slices", [None, 2])
def test_outs_inside_an_appearance(spark, slices):
    df = appearance(spark, [0, 1, 2, 0, 2, 1, None, 1, 1])
    assert outs(df, slices=slices) == [0, 1, 1, 1, 2, 2, None, None, 0]


@pytest.mark.parametrize(
    "event, made", [("strikeout", 1), ("double_play", 2), ("triple_play", 3), (None, 1), ("field_out", 1), ("pickoff_1b", 1)]
)
def test_last_pitch_decides(spark, event, made):
    assert outs(appearance(spark, [0, 1], [None, event])) == [0, made]


def test_last_pitch_without_event_strict(spark):
    assert outs(appearance(spark, [0, 1], [None, ""]), missing_event="null") == [0, None]
    # with the cleaned column a pickoff is no event any more
    assert outs(appearance(spark, [0, 1], [None, "pickoff_1b"]), event="events", missing_event="null") == [0, None]
    assert outs(appearance(spark, [0], ["strikeout"])) == [1]


def test_pitcher_line(spark):
    # changes 0, 0, 1, 1 and one out for the strikeout on the last pitch: one inning
    df = appearance(spark, [0, 0, 1, 2, 2], ["walk", "home_run", "strikeout", None, "strikeout"])
    df = df.union(appearance(spark, [0], ["single"], pitcher=2, role="RP"))
    df = df.union(appearance(spark, [0], ["hit_by_pitch"], pitcher=3, role="RP"))
    a, b, hbp = as_dicts(pitcher_lines(clean_events(df)), "pitcher")
    assert (a["IP"], a["WHIP"], a["ERA"], a["SOBBratio"], a["batters_faced"]) == (1.0, 2.0, 9.0, 2.0, 5)
    assert (a["H"], a["HR"], a["ER"], a["SO"], a["BB"], a["HBP"], a["H9"], a["SO9"]) == (1, 1, 1, 2, 1, 0, 9.0, 18.0)
    assert b["IP"] == 0 and b["WHIP"] == math.inf and math.isnan(b["SOBBratio"])
    assert math.isnan(hbp["WHIP"])
    lines = pitcher_lines(clean_events(df))
    rel = as_dicts(reliever_rows(lines), "pitcher")
    assert [(r["WHIP"], r["SOBBratio"]) for r in rel] == [(12.0, 0.0), (0.0, 0.0)]
    assert [r["pitcher"] for r in as_dicts(starter_rows(lines))] == [1]


def test_batters_faced_takes_the_last_number_of_each_game(spark):
    df = appearance(spark, [0, 1, 2]).union(appearance(spark, [0, 1], game=2)).union(appearance(spark, [0], game=3, role="RP"))
    got = {r["role_key"]: r["batters_faced"] for r in batters_faced(clean_events(df)).collect()}
    assert got == {"SP": 5, "RP": 1}


def pitch_measures(df):
    have = set(df.columns)
    for i, m in enumerate(codes.GAME_MEANS.values()):
        if m not in have:
            df = df.withColumn(m, (F.col("pitch_number_appearance") * 10 + i).cast("double"))
    return df.withColumns({"pitch_type": F.lit("FF"), "type": F.lit("S"), "bb_type": F.lit(None).cast("string"), "launch_speed_angle": F.lit(6)})


def test_pitch_type_rollup(spark):
    df = appearance(spark, [0] * 9).union(appearance(spark, [0], game=2)).union(appearance(spark, [0], game=2, role="RP"))
    clean = clean_events(pitch_measures(df))
    games = as_dicts(pitch_type_games(clean), "game_pk")
    assert [g["strikes"] for g in games] == [9, 2] and games[0]["pitches_thrown"] == 9 and games[0]["barreled_contact"] == 9
    season = as_dicts(pitch_type_seasons(pitch_type_games(clean)))[0]
    assert season["release_speed"] == pytest.approx((50 + 10) / 2)  # mean of the games, not of the pitches
    assert season["pitches_thrown"] == 11
    named = as_dicts(pitch_type_games(clean, launch_speed="launch_angle"), "game_pk")[0]
    assert named["launch_speed"] == named["launch_angle"] != games[0]["launch_speed"]
    assert pitch_type_table(clean).count() == 2  # both roles


def test_the_pitches_of_a_game_are_gathered_before_they_are_combined(spark):
    hot = appearance(spark, [0] * 40)
    df = hot.union(appearance(spark, [0] * 3, game=2)).union(appearance(spark, [0] * 2, game=None)).repartition(8)
    clean = clean_events(pitch_measures(df))
    games, plain = pitch_type_games(clean), pitch_type_games(clean, gathered=True)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(games).index("Aggregate") < plan(games).index("RebalancePartitions")
    assert "RebalancePartitions" in plan(pitch_type_table(clean)) and "RebalancePartitions" not in plan(plain)
    by_game = lambda d: as_dicts(d.withColumn("k", F.coalesce("game_pk", F.lit(0))), "k")
    assert by_game(games) == by_game(plain) and [g["strikes"] for g in by_game(games)] == [2, 40, 3]


def test_projection_of_pitchers(spark):
    stats = codes.PITCHER_STATS
    rows = [(p, y, "SP", *[v] * 8) for p, y, v in [(1, 2021, 1.0), (1, 2022, 2.0), (1, 2023, 4.0), (2, 2023, 3.0), (3, 2021, 5.0)]]
    rows += [(4, 2023, "SP", *[math.inf] * 8), (1, 2023, "RP", *[9.0] * 8)]
    lines = spark.createDataFrame(rows, "pitcher long, year int, role_key string, " + ", ".join(f"{s} double" for s in stats))
    got = {r["pitcher"]: r["WHIP"] for r in project_pitchers(lines, "SP", (2021, 2022, 2023)).collect()}
    assert got == {1: pytest.approx(2.8), 2: 3.0, 3: None}


def test_hitter_projection_ages_the_player(spark):
    people = spark.createDataFrame([(1, D(1990, 4, 1))], "player_mlb_id long, birthDate date")
    log = batting(spark, ["single", "double", "walk", "strikeout", "sac_fly"])
    for year in (2022, 2023):
        log = log.union(batting(spark, ["single", "double", "walk", "strikeout", "sac_fly"], date=D(year, 5, 1), game=year))
    hitters = complete_hitters(batter_seasons(clean_events(log), people))
    assert hitters.count() == 3
    row = as_dicts(project_hitters(hitters, people, (2021, 2022, 2023)))[0]
    assert row["age"] == 34 and row["SF"] == pytest.approx(1.0) and row["TB"] == pytest.approx(3.0)


def test_a_person_listed_twice_raises(spark):
    who = spark.createDataFrame([(1, "1990-04-01"), (1, "1991-04-01"), (None, "1990-01-01"), (None, "1990-01-01")], "player_mlb_id long, birthDate string")
    lines = spark.createDataFrame([(1, 2021)], "batter long, year int")
    with pytest.raises(Exception, match="more than one row of people"):
        with_age(lines, who, "batter").collect()
    assert with_age(lines, who.filter("birthDate < '1991-01-01'"), "batter").first()["age"] == 31
