"""Models of playing time, and the table asked for: one number per roster player."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.base import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import stack_sum
from ..operators.cleaning import time_split, zero_fill
from ..operators.columns import features_and_label
from ..operators.joins import roster_complete
from ..operators.models import assemble, at_once, best_of, best_round, coarse_to_fine, fit, forest, gbt, score, with_folds
from ..session import cut_lineage
from . import codes
from .hitters import batter_seasons, clean_events, complete_hitters, project_hitters
from .pitchers import pitcher_lines, project_pitchers, reliever_rows, starter_rows

PLAYER, TIME = "PLAYER_ID", "PLAYING_TIME"


@dataclass
class Candidate:
    """A model and how its settings are found on the training seasons.

    ``rounds``: keep as many boosting rounds as do best on held-out folds.
    ``stages``: grids searched one after the other, each from the best so far.
    ``watch``: stop boosting early by the rows of one fold.
    """

    model: Estimator
    rounds: bool = False
    stages: Sequence[Mapping[str, Sequence]] = ()
    watch: bool = False


def default_roles() -> dict[str, dict[str, Candidate]]:
    """The candidates of each role."""
    # fixed values: the settings that tuning ended with, and the searches it used
    unlimited = 30  # the deepest that MLlib grows
    return {
        "hitter": {
            "gbt": Candidate(gbt(trees=80, step=0.22, depth=4, subsample=0.75)),
            "forest": Candidate(forest(trees=200, depth=unlimited, feature_subset="10")),
        },
        "reliever": {"gbt": Candidate(gbt(trees=100, step=0.2, depth=6), rounds=True)},
        "starter": {
            "gbt": Candidate(
                gbt(trees=100, step=0.1, depth=6), stages=({"maxDepth": [4, 6]}, {"stepSize": [0.05, 0.1, 0.2]}), watch=True
            ),
            "forest": Candidate(forest(trees=500, depth=unlimited)),
        },
    }


@dataclass
class Settings:
    """What the forecast leaves open: the seasons, the candidates of each role, the folds of the searches.

    ``rows``: cut games of more rows, see ``operators/windows.py``.
    """

    seasons: Sequence[int] = (2021, 2022, 2023)
    roles: Mapping[str, Mapping[str, Candidate]] = field(default_factory=default_roles)
    pitch_order: Sequence[str] = ("pitch_number_appearance",)
    folds: int = 3
    rows: int | None = None


def _tuned(candidate: Candidate, train: DataFrame, folds: int) -> Estimator:
    """The candidate's estimator with the settings found on the training rows."""
    est = candidate.model
    if candidate.stages:
        best, _ = coarse_to_fine(est, candidate.stages, train, k=folds, metric="rmse")
        est = est.copy({est.getParam(p): best.getOrDefault(p) for stage in candidate.stages for p in stage})
    if candidate.rounds:
        est = best_round(est, train, folds)
    if candidate.watch:
        stopped = fit(est.copy({est.validationIndicatorCol: "watch"}), train.withColumn("watch", F.col("fold") == 0))
        est = est.copy({est.maxIter: stopped.getNumTrees})
    return est


def choose_and_refit(
    table: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    candidates: Mapping[str, Candidate],
    settings: Settings,
    refit_all: bool = True,
) -> Model:
    """Tune and fit every candidate on the earlier seasons, keep the best on the last one.

    ``refit_all`` then fits the winner's settings on all seasons. Folds are by
    ``key``, so the seasons of one player stay together.
    """
    rows = assemble(features_and_label(table, features, label, [key, "year"]), features)
    rows = with_folds(rows, key, settings.folds).filter(F.col("year").isin(list(settings.seasons)))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)  # read by every fit
    try:
        train, test = time_split(rows, "year", settings.seasons[:-1], settings.seasons[-1:])
        names = list(candidates)
        found = at_once(rows.sparkSession, lambda name: _tuned(candidates[name], train, settings.folds), names, len(names))
        tuned = dict(zip(names, found, strict=True))
        if len(tuned) == 1 and refit_all:
            return next(iter(tuned.values())).fit(rows)
        models = dict(zip(names, at_once(rows.sparkSession, lambda name: tuned[name].fit(train), names, len(names)), strict=True))
        name, model = best_of(models, test)
        return tuned[name].fit(rows) if refit_all else model
    finally:
        rows.unpersist()


def predictions(model: Model, projected: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """(PLAYER_ID, PLAYING_TIME) from projected features."""
    scored = score(model, assemble(projected, features), [key], TIME)
    return scored.withColumnRenamed(key, PLAYER)


def submission(roster: DataFrame, hitters: DataFrame, *pitchers: DataFrame) -> DataFrame:
    """Sum a player's predictions over all roles; roster players without any get 0."""
    all_pitchers = stack_sum(pitchers, PLAYER, TIME)
    return roster_complete(roster, stack_sum([hitters, all_pitchers], PLAYER, TIME), PLAYER, TIME)


def playing_time(pitches: DataFrame, people: DataFrame, roster: DataFrame, settings: Settings) -> DataFrame:
    """Events to submission.

    The two season tables are checkpointed: each is read by several fits, and
    neither a fit nor a lost executor should start over from the events.
    """
    clean = clean_events(pitches, settings.seasons)
    hitters = cut_lineage(complete_hitters(batter_seasons(clean, people, rows=settings.rows)))
    lines = cut_lineage(pitcher_lines(clean, order=settings.pitch_order, rows=settings.rows))

    pitching = ("pitcher", codes.PITCHER_STATS, codes.PITCHER_LABEL)
    tables = {
        "hitter": (hitters, "batter", codes.HITTER_FEATURES, codes.HITTER_LABEL),
        "reliever": (reliever_rows(lines), *pitching),
        "starter": (starter_rows(lines), *pitching),
    }
    # the roles know nothing of each other: their fits share the cluster
    fitted = at_once(
        roster.sparkSession, lambda role: choose_and_refit(*tables[role], settings.roles[role], settings), list(tables), len(tables)
    )
    hit_model, rp_model, sp_model = fitted

    seasons = settings.seasons
    rp = project_pitchers(lines, "RP", seasons).filter(F.col("H").isNotNull())
    sp = zero_fill(project_pitchers(lines, "SP", seasons), codes.PITCHER_STATS)
    return submission(
        roster,
        predictions(hit_model, project_hitters(hitters, people, seasons), codes.HITTER_FEATURES, "batter"),
        predictions(rp_model, rp, codes.PITCHER_STATS, "pitcher"),
        predictions(sp_model, sp, codes.PITCHER_STATS, "pitcher"),
    )
