"""From pitch events to batter seasons: counts, rates, age, lineup spot, projection."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    blank_to_null,
    completed_years,
    count_where,
    is_in,
    longer_than,
    null_if_in,
    ratio,
    round_to,
    weighted_sum,
)
from ..operators.aggregate import (
    agg_then_derive,
    counts_by_code,
    distinct_count,
    shares,
    weighted_position,
)
from ..operators.cleaning import drop_incomplete, inf_to_null
from ..operators.columns import horizontal_sum
from ..operators.joins import left
from ..operators.projection import project_next
from ..operators.windows import cyclic_rank
from . import codes

c = F.col


def clean_events(pitches: DataFrame, seasons: Sequence[int] | None = None) -> DataFrame:
    """Season of each pitch; ``events`` only where a plate appearance ended.

    ``raw_events`` keeps every event (blank is missing), which the outs logic
    needs. ``seasons`` keeps only the pitches from the first to the last of
    them, as a date range: unlike a condition on the year, a range is pushed
    into the scan.
    """
    if seasons:
        pitches = pitches.filter(
            c("game_date").between(dt.date(min(seasons), 1, 1), dt.date(max(seasons), 12, 31))
        )
    return pitches.withColumn("raw_events", blank_to_null("events")).withColumns(
        {"events": null_if_in("raw_events", codes.NOT_PLATE_APPEARANCE), "year": F.year("game_date")}
    )


def _hitting_rates(rounding: str, on_zero: str, factor: Column | None = None) -> tuple[dict, dict]:
    """Rates from counts, and rates from these, already rounded.

    ``factor`` divides SLG and multiplies what OPS and ISO are made of.
    """
    factor = F.lit(1.0) if factor is None else factor

    def rate(num: Column, den: Column) -> Column:
        return round_to(ratio(num, den, on_zero), 3, rounding)

    rates = {
        "PA_PG": rate(c("PA"), c("games")),
        "BA": rate(c("H"), c("AB")),
        "OBP": rate(c("H") + c("BB") + c("HBP"), c("AB") + c("BB") + c("HBP") + c("SF")),
        "SLG": rate(c("TB"), c("AB") * factor),
        "BABIP": rate(c("H") - c("HR"), c("AB") - c("SO") - c("HR") + c("SF")),
        "K_perc": rate(c("SO"), c("PA")),
        "BB_perc": rate(c("BB"), c("PA")),
        "HR_perc": rate(c("HR"), c("PA")),
        "RC": rate((c("H") + c("BB")) * c("TB"), c("PA")),
        "Contact_perc": rate(c("AB") - c("SO"), c("AB")),
        "BB_K_ratio": rate(c("BB"), c("SO")),
        "XBH_perc": rate(c("XBH"), c("H")),
    }
    from_rates = {
        "OPS": round_to(c("OBP") * factor + c("SLG") * factor, 3, rounding),
        "ISO": round_to(c("SLG") * factor - c("BA") * factor, 3, rounding),
        "RC_per_PA": rate(c("RC"), c("PA")),
    }
    return rates, from_rates


def batter_lines(
    clean: DataFrame,
    keys: Sequence[str] = ("batter", "year"),
    rounding: str = "half_even",
    on_zero: str = "null",
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per batter and season: 16 counts and 15 rates.

    ``extra`` adds aggregates of the same rows to the same pass.
    """

    def events(*names: str) -> Column:
        return count_where(is_in("events", names))

    counts = {
        "games": distinct_count("game_date"),
        "PA": F.count(F.lit(1)),
        "H": events(*codes.HITS),
        "Singles": events("single"),
        "Doubles": events("double"),
        "Triples": events("triple"),
        "HR": events("home_run"),
        "SO": events("strikeout"),
        "BB": events("walk"),
        "HBP": events("hit_by_pitch"),
        "SF": events("sac_fly"),
        "SB": events("sac_bunt"),
        "CI": events("catcher_interf"),
        "AB": events(*codes.AT_BATS),
    }
    totals = {
        "XBH": c("Doubles") + c("Triples") + c("HR"),
        "TB": c("Singles") + 2 * c("Doubles") + 3 * c("Triples") + 4 * c("HR"),
    }
    rates, from_rates = _hitting_rates(rounding, on_zero)
    counts |= dict(extra or {})
    return agg_then_derive(clean.filter(c("events").isNotNull()), keys, counts, totals, rates, from_rates)


def season_weight(year: str, seasons: Sequence[int], weights: Sequence[float] = codes.SEASON_WEIGHTS) -> Column:
    """The weight of a season as an exact decimal; missing for a season without one."""
    out = F.when(c(year) == seasons[0], F.lit(Decimal(str(weights[0]))))
    for season, weight in zip(seasons[1:], weights[1:], strict=True):
        out = out.when(c(year) == season, F.lit(Decimal(str(weight))))
    return out.cast("decimal(10,6)")


def with_age(
    df: DataFrame, people: DataFrame, on: str, year: Column | str = "year", person: str = "player_mlb_id"
) -> DataFrame:
    """Birth date and completed years on 1 April of the season.

    A person listed twice raises while the query runs.
    """
    births = people.filter(c(person).isNotNull()).groupBy(person).agg(
        F.count(F.lit(1)).alias("_listed"), F.max(c("birthDate").cast("date")).alias("birthDate")
    )
    twice = F.concat(F.lit(f"more than one row of people with {person} = "), c(person).cast("string"))
    births = births.filter(F.when(c("_listed") > 1, F.raise_error(twice).cast("boolean")).otherwise(F.lit(True))).drop("_listed")
    season = F.col(year) if isinstance(year, str) else year
    return left(df, births, left_on=[on], right_on=[person]).withColumn(
        "age", completed_years("birthDate", F.make_date(season, F.lit(4), F.lit(1)))
    )


def _spot_names(spots: int) -> dict[int, str]:
    return {i: f"spot{i:02d}" for i in range(1, spots + 1)}


def lineup_spots(clean: DataFrame, spots: int = 9, rows: int | None = None, slices: int | None = None) -> DataFrame:
    """How often a batter took each lineup spot in a season, and the mean spot.

    ``slices`` gives ``rows`` as a share of the table.
    """
    if slices:
        rows = max(1, -(-clean.count() // slices))
    at_bats = clean.filter(longer_than("events", 2)).select(
        "game_pk", "inning_topbot", "at_bat_number", "batter", "year"
    )
    placed = cyclic_rank(at_bats, ["game_pk", "inning_topbot"], ["at_bat_number"], spots, "spot", rows)
    names = _spot_names(spots)
    counted = counts_by_code(placed, ["batter", "year"], "spot", names)
    counted = counted.withColumn("AB", horizontal_sum(list(names.values())))
    shared = shares(counted, list(names.values()), "AB")
    return shared.withColumn("weighted_spot_avg", weighted_position([f"{n}_per" for n in names.values()]))


def batter_seasons(
    clean: DataFrame, people: DataFrame, spots: int = 9, rows: int | None = None, **lines
) -> DataFrame:
    """The hitters' feature table: season line, age and mean lineup spot.

    One pass over the events: the spot of each at-bat is ranked first, then the
    spots are counted next to the counters of the season line. Only the small
    season table meets the people.
    """
    needed = ["game_pk", "inning_topbot", "at_bat_number", "batter", "year", "game_date", "events"]
    ended = clean.filter(c("events").isNotNull()).select(*needed, longer_than("events", 2).alias("_listed"))
    placed = cyclic_rank(ended, ["game_pk", "inning_topbot", "_listed"], ["at_bat_number"], spots, "spot", rows)
    names = _spot_names(spots)
    taken = {n: count_where((c("spot") == i) & c("_listed")) for i, n in names.items()}
    table = batter_lines(placed, extra=taken, **lines)
    shared = shares(table.withColumn("_spots", horizontal_sum(list(names.values()))), list(names.values()), "_spots")
    share_names = [f"{n}_per" for n in names.values()]
    placed_table = shared.withColumn("weighted_spot_avg", weighted_position(share_names))
    return with_age(placed_table.drop("_spots", *names.values(), *share_names), people, "batter")


def decay_weighted(
    lines: DataFrame,
    seasons: Sequence[int],
    weights: Sequence[float] = codes.SEASON_WEIGHTS,
    variant: str = "corrected",
    rounding: str = "half_even",
) -> DataFrame:
    """Next season per batter from season-weighted sums.

    Counts are weighted sums in both variants. ``corrected`` takes every rate
    as a ratio of weighted sums. ``faithful`` keeps the effect of summing a
    value that is already a total over the weights of the player's seasons:
    SLG is divided, OPS and ISO are multiplied by the sum of the weights.

    The sums are taken in decimals: the order in which tasks finish then cannot
    move a rate across a rounding boundary.
    """
    if variant not in ("corrected", "faithful"):
        raise ValueError(f"unknown variant {variant!r}")
    counted = ["games", "PA", "H", "Singles", "Doubles", "Triples", "HR", "SO", "BB", "HBP", "SF", "SB", "CI", "AB", "XBH", "TB"]
    weighted = lines.withColumn("weight", season_weight("year", seasons, weights))
    weighted = weighted.filter(c("weight").isNotNull())
    sums = {n: weighted_sum(n, "weight").cast("double") for n in counted}
    sums["_W"] = F.sum("weight").cast("double")
    sums["PA_PG"] = weighted_sum(c("PA_PG").cast("decimal(20,3)"), "weight").cast("double")
    factor = c("_W") if variant == "faithful" else F.lit(1.0)
    rates, from_rates = _hitting_rates(rounding, "null", factor)
    if variant == "faithful":
        rates["PA_PG"] = round_to("PA_PG", 3, rounding)
    return agg_then_derive(weighted, ["batter"], sums, rates, from_rates).drop("_W")


def next_season_table(
    lines: DataFrame, people: DataFrame, seasons: Sequence[int], weights: Sequence[float] = codes.SEASON_WEIGHTS, **how
) -> DataFrame:
    """``decay_weighted`` with the season it stands for, birth date and age in it."""
    out = decay_weighted(lines, seasons, weights, **how).withColumn("year", F.lit(seasons[-1] + 1))
    return with_age(out, people, "batter")


def complete_hitters(seasons_table: DataFrame) -> DataFrame:
    """Rows a model can use: infinities made missing, incomplete rows dropped."""
    return drop_incomplete(inf_to_null(seasons_table))


def project_hitters(hitters: DataFrame, people: DataFrame, seasons: Sequence[int]) -> DataFrame:
    """Next season's features of the batters seen in the last season."""
    projected = project_next(hitters, "batter", "year", codes.HITTER_WEIGHTS, seasons)
    aged = with_age(projected, people, "batter", F.lit(seasons[-1] + 1)).drop("birthDate")
    return drop_incomplete(aged)
