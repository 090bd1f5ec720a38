"""From pitch events to pitcher seasons: pitch-type rollups, outs, rates, projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import count_where, is_in, rate_per, ratio
from ..operators.aggregate import agg_then_derive, gather, rollup_max_sum, two_level
from ..operators.cleaning import drop_incomplete, finite_rows, impute, inf_to_null
from ..operators.columns import horizontal_sum
from ..operators.joins import left
from ..operators.projection import project_next
from ..operators.windows import state_change
from . import codes

c = F.col


def pitch_type_games(
    clean: DataFrame, launch_speed: str = "launch_speed", strict_null: bool = False, gathered: bool = False
) -> DataFrame:
    """One row per pitcher, season, game and pitch type: 27 means, 12 counters.

    ``launch_speed`` names the column averaged under that name. With
    ``strict_null`` a counter is missing where any of its inputs is. The pitches
    of a game are brought together first, unless ``gathered`` says that they are.
    """
    if not gathered:
        clean = gather(clean, ["pitcher", "game_pk"])
    means = codes.GAME_MEANS | {"launch_speed": launch_speed}
    aggs = {name: F.avg(source) for name, source in means.items()}
    aggs |= {name: count_where(c(source) == value, strict_null) for name, (source, value) in codes.GAME_COUNTERS.items()}
    return agg_then_derive(
        clean, ["pitcher", "year", "game_pk", "pitch_type"], aggs, {"pitches_thrown": horizontal_sum(codes.PITCHES_THROWN)}
    )


def pitch_type_seasons(games: DataFrame) -> DataFrame:
    """Per pitcher, season and pitch type: means of the game means, sums of the counters."""
    aggs = {name: F.avg(name) for name in codes.SEASON_MEANS}
    aggs |= {name: F.sum(name) for name in [*codes.GAME_COUNTERS, "pitches_thrown"]}
    return agg_then_derive(games, ["pitcher", "year", "pitch_type"], aggs)


def batters_faced(clean: DataFrame) -> DataFrame:
    """Per pitcher, season and role: the last batter number of each game, summed."""
    return rollup_max_sum(
        clean, ["pitcher", "year", "role_key"], ["game_pk"], "pitcher_at_bat_number", "batters_faced"
    )


def pitch_type_table(clean: DataFrame, launch_speed: str = "launch_speed") -> DataFrame:
    """Pitch-type seasons with batters faced per role.

    Joined without the role, so a pitcher with both roles has each pitch type twice.
    """
    seasons = pitch_type_seasons(pitch_type_games(clean, launch_speed))
    return left(seasons, batters_faced(clean), on=["pitcher", "year"], expect="m:n")


def outs_recorded(
    clean: DataFrame,
    event: str = "raw_events",
    missing_event: str = "keep",
    order: Sequence[str] = ("pitch_number_appearance",),
    rows: int | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add ``out_diff``: the outs each pitch brought, from the outs counter.

    Inside an appearance it is the change of the counter; on the last pitch the
    event decides. A last pitch without an event keeps its change
    (``missing_event="keep"``) or counts as missing (``"null"``). ``slices`` gives ``rows`` as a share of the table.
    """
    if slices:
        rows = max(1, -(-clean.count() // slices))
    last = (
        F.when(is_in(event, codes.SINGLE_OUTS), 1)
        .when(is_in(event, codes.DOUBLE_OUTS), 2)
        .when(is_in(event, codes.TRIPLE_OUTS), 3)
    )
    if missing_event == "keep":
        last = last.otherwise(c("out_diff"))
    elif missing_event == "null":
        last = last.when(c(event).isNotNull(), c("out_diff"))
    else:
        raise ValueError(f"missing_event must be 'keep' or 'null', not {missing_event!r}")
    return state_change(
        clean,
        ["pitcher", "game_pk"],
        order,
        "outs_when_up",
        "out_diff",
        wrap=codes.OUTS_WRAP,
        first=0,
        last_by="pitch_number_appearance",
        on_last=last,
        rows=rows,
    )


def pitcher_lines(
    clean: DataFrame,
    event: str = "raw_events",
    missing_event: str = "keep",
    order: Sequence[str] = ("pitch_number_appearance",),
    on_zero: str = "ieee",
    rows: int | None = None,
) -> DataFrame:
    """One row per pitcher, role and season: innings, counts and rates, batters faced."""
    needed = ["pitcher", "game_pk", "role_key", "year", "outs_when_up", "events", "bat_score", "post_bat_score",
              "pitcher_at_bat_number", "pitch_number_appearance", event]
    pitches = clean.select(*dict.fromkeys([*needed, *order]))
    pitches = outs_recorded(pitches, event, missing_event, order, rows)
    counters = {
        "_outs": F.sum("out_diff"),
        "_on_base": count_where(is_in("events", ["walk", *codes.HITS])),
        "H": count_where(is_in("events", codes.HITS)),
        "HR": count_where(c("events") == "home_run"),
        "ER": F.sum(c("post_bat_score") - c("bat_score")),
        "SO": count_where(is_in("events", codes.PITCHER_STRIKEOUTS)),
        "BB": count_where(c("events") == "walk"),
        "HBP": count_where(c("events") == "hit_by_pitch"),
    }
    # per game first: the rows are already together by (pitcher, game), and the
    # last batter number of each game comes along, so no second pass or join
    lines = two_level(
        pitches,
        ["pitcher", "role_key", "year"],
        ["game_pk"],
        {**counters, "batters_faced": F.max("pitcher_at_bat_number")},
        {name: F.sum(name) for name in [*counters, "batters_faced"]},
    )
    innings = ratio(F.coalesce(c("_outs"), F.lit(0)), F.lit(3))
    rates = {
        "IP": innings,
        "WHIP": ratio("_on_base", innings, on_zero),
        "SOBBratio": ratio("SO", "BB", on_zero),
    }
    per_nine = {
        name: rate_per(source, "IP", 9, on_zero)
        for name, source in {"ERA": "ER", "H9": "H", "HR9": "HR", "BB9": "BB", "SO9": "SO"}.items()
    }
    return lines.withColumns(rates).withColumns(per_nine).drop("_outs", "_on_base")


def reliever_rows(lines: DataFrame, cap: str | dict = "fixed") -> DataFrame:
    """Relievers with infinite and missing ratios replaced.

    ``cap="fixed"`` uses the fixed caps, ``"max"`` the largest finite value in the data.
    """
    rules = codes.RELIEVER_IMPUTE
    if cap == "max":
        rules = {name: ("max", missing) for name, (_, missing) in rules.items()}
    return impute(lines.filter(c("role_key") == "RP"), rules)


def starter_rows(lines: DataFrame) -> DataFrame:
    """Starters whose features are all present and finite."""
    return finite_rows(lines.filter(c("role_key") == "SP"), codes.PITCHER_STATS)


def project_pitchers(lines: DataFrame, role: str, seasons: Sequence[int]) -> DataFrame:
    """Next season's features of one role; NULL for a pitcher not seen in the last season."""
    complete = drop_incomplete(inf_to_null(lines))
    return project_next(complete.filter(c("role_key") == role), "pitcher", "year", codes.PITCHER_WEIGHTS, seasons)
