"""The boosted projector: games, opportunities a game, efficiency, and quantiles of points, all folds at once.

    points = games x opportunities a game x points an opportunity

Games and opportunities are boosted (``boosting``), efficiency is shrunk to its
group's mean by a fitted constant, and three quantile problems give the range. Every
fold is a set of problems of the same run, so no fold costs a pass of its own. The
prior of a stage never lowers its prediction. With ``games`` (a row a scheduled game)
opportunities are learned and predicted a game, and summed over the schedule.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, weighted_sum
from ..operators.lineage import settled
from . import projectors as P
from .boosting import Model, Problem, boosted, fit_design, tuned_rounds

QUANTILES = (0.1, 0.5, 0.9)


@dataclass
class Games:
    """Scheduled games: ``rows`` of a panel expanded to its games, with ``features`` and the label ``opportunities`` (null where a game wasn't played)."""

    expand: Callable[[DataFrame], DataFrame]
    opportunities: str
    numeric: Sequence[str] = ()
    categories: Sequence[str] = ()
    rising: Sequence[str] = ()


@dataclass
class Learned:
    """Settings of the projector; ``models`` holds what was fitted, by stage."""

    numeric: Sequence[str]
    categories: Sequence[str] = ("grp",)
    points: str = "points"
    opportunities: str = "opportunities"
    games: Games | None = None
    rounds: int = 50
    tune: bool = False
    default_rounds: int = 300
    most_games: float = 17.0
    options: dict = field(default_factory=dict)
    models: dict[str, Model] = field(default_factory=dict)

    def __call__(self, panel: DataFrame, tests: Sequence[int]) -> DataFrame:
        """Test rows of every fold with ``pred_games, pred_opportunities`` (a game) ``, efficiency, pred_ppg, pred_points, pred_q10, pred_q50, pred_q90``."""
        kept = panel.columns
        panel = settled(with_priors(panel, self.opportunities))
        per_game = F.try_divide(F.col(self.opportunities), F.nullif(F.col("games"), F.lit(0.0)))
        rows = panel.withColumn("__pg", per_game)
        stages = {"games": ("games", ()), **{f"q{round(100 * q)}": (self.points, ()) for q in QUANTILES}}
        if self.games is None:
            stages["opportunities"] = ("__pg", ("prior_opportunities",))
        quantile = {f"q{round(100 * q)}": q for q in QUANTILES}
        features = [*self.numeric, *_PRIORS]
        model = self._fit("season", rows, tests, features, self.categories, {s: (label, rising, quantile.get(s)) for s, (label, rising) in stages.items()})
        test = rows.where(F.col("season").isin(*tests))
        out = model.predict(test, {f"__{s}": _named(s) for s in stages})
        out = P.fold_efficiency_of(out, panel, tests, self.points, self.opportunities)
        out = out.withColumn("pred_games", clip(F.col("__games"), 0.0, self.most_games))
        if self.games is None:
            out = out.withColumn("pred_opportunities", clip(F.col("__opportunities"), 0.0))
            rate = F.col("pred_opportunities") * F.col("efficiency")
        else:
            out = out.join(self._by_game(rows, tests), ["entity", "season"], "left").withColumn("pred_opportunities", F.coalesce("pred_opportunities", F.lit(0.0)))
            rate = F.when(F.col("pred_games") > 0, F.col("pred_opportunities") * F.col("efficiency")).otherwise(0.0)
        names = [f"pred_{s}" for s in quantile]
        out = out.withColumn("pred_ppg", clip(rate, 0.0)).withColumns({"pred_points": F.col("pred_ppg") * F.col("pred_games"), **{f"pred_{s}": F.col(f"__{s}") for s in quantile}})
        out = P.ordered_quantiles(out, names)
        return out.select(*kept, "pred_games", "pred_opportunities", "efficiency", "pred_ppg", "pred_points", *names)

    def _fit(self, stage: str, rows: DataFrame, tests: Sequence[int], numeric: Sequence[str], categories: Sequence[str], labels: dict) -> Model:
        """One model of every label in every fold; bins come from the seasons that train all folds."""
        design = fit_design(rows.where(F.col("season") < min(tests)), numeric, categories)
        season = F.col("season")
        problems = [Problem(f"{s}@{t}", label, season < t, q, tuple(rising)) for s, (label, rising, q) in labels.items() for t in tests]
        rounds = {}
        if self.tune:  # the last training season chooses the rounds, then all of them train
            trial = [Problem(p.name, p.label, season < t - 1, p.quantile, p.rising, season == t - 1) for p, t in zip(problems, [t for _ in labels for t in tests], strict=True)]
            rounds = tuned_rounds(boosted(rows, design, trial, self.rounds, **self.options), rows, self.default_rounds)
        model = boosted(rows, design, problems, max(rounds.values()) if rounds else self.rounds, **self.options)
        self.models[stage] = model.used(rounds) if rounds else model
        return self.models[stage]

    def _by_game(self, rows: DataFrame, tests: Sequence[int]) -> DataFrame:
        """``entity, season, pred_opportunities``: the mean over the season's scheduled games."""
        own = self.games
        games = settled(own.expand(rows))
        labels = {"opportunities": (own.opportunities, (*own.rising, "prior_opportunities"), None)}
        model = self._fit("game", games, tests, [*self.numeric, *_PRIORS, *own.numeric], [*self.categories, *own.categories], labels)
        found = model.predict(games.where(F.col("season").isin(*tests)), {"__o": _named("opportunities")})
        return found.groupBy("entity", "season").agg(F.avg(clip(F.col("__o"), 0.0)).alias("pred_opportunities"))


_PRIORS = ("prior_games", "prior_opportunities", "prior_points")


def _named(stage: str) -> Column:
    return F.concat(F.lit(f"{stage}@"), F.col("season").cast("string"))


def with_priors(panel: DataFrame, opportunities: str = "opportunities", weights: Sequence[float] = (5.0, 4.0, 3.0)) -> DataFrame:
    """Weighted games of the lagged seasons, and opportunities and points a weighted game (null without any)."""
    lags = range(1, len(weights) + 1)
    games, chances, points = (weighted_sum([F.col(f"prev{n}_{c}") for n in lags], list(weights)) for c in ("games", opportunities, "points"))
    return panel.withColumns({"prior_games": games, "prior_opportunities": F.when(games > 0, F.try_divide(chances, games)), "prior_points": F.when(games > 0, F.try_divide(points, games))})


def rookies(settings: Learned) -> Callable[[DataFrame, Sequence[int]], DataFrame]:
    """The projector that learns from rookies of earlier seasons alone and projects rookies alone."""
    return P.rookies_only(settings)


def blended(settings: Learned, weights: Sequence[float] = (5.0, 4.0, 3.0), share: float = 0.35) -> Callable[[DataFrame, Sequence[int]], DataFrame]:
    """The projector with its rate and games moved by ``share`` to those of the weighted prior."""
    return lambda panel, tests: P.blend(settings(panel, tests), P.weighted_prior(panel, tests, weights), share)


def project_season(history: DataFrame, target: DataFrame, season: int, settings: Learned, rookie_settings: Learned | None = None, ranked: Callable[[DataFrame, Sequence[int]], DataFrame] | None = None) -> DataFrame:
    """The board of a season that hasn't been played: everybody from the model of all earlier seasons, rookies from that of earlier rookies, those with a market's rank by ``ranked``.

    Columns of ``target`` with the predictions, ``projection_source``, ``rank`` and ``group_rank``.
    """
    past = history.where(F.col("season") < season)
    if past.isEmpty():
        raise ValueError(f"no completed seasons before {season}")
    both = past.unionByName(target.where(F.col("season") == season), allowMissingColumns=True)
    named = lambda df, name: df.where(F.col("season") == season).withColumn("projection_source", F.lit(name))
    sources = [named(settings(both, [season]), "gbm")]
    new = both.where("is_rookie")
    if rookie_settings is not None and not new.where(F.col("season") == season).isEmpty():
        sources.insert(0, named(rookies(rookie_settings)(both, [season]), "rookie_gbm"))
        if ranked is not None:
            sources.insert(0, named(ranked(new, [season]), "rookie_rank"))
    return P.board(sources, ["entity", "season"], [F.col("pred_points").desc_nulls_last(), "entity"])
