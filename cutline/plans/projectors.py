"""Projection ladder and its scores, as column algebra over a lagged panel.

A panel has one row an entity-season: ``entity, season, grp, games, points`` and
lags ``prev{1,2,3}_games`` and ``prev{1,2,3}_points``. Rows train a fold where their
season is before the fold's; all folds of a rung are fitted from one aggregate by
season and group (``moments``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, shrink, weight_mass, weighted_sum
from ..operators.lineage import settled
from ..operators.ranks import nearest_quantiles, numbered, overall_rank, spearman
from .moments import Fit, before_each_fold, best_constants, fold_means, shrink_sums, with_means


def folds(first: int, last: int, min_train: int = 3) -> list[int]:
    """Test seasons that have ``min_train`` seasons before them."""
    return list(range(first + min_train, last + 1))


def rate_estimate(weights: Sequence[float], mu: Column, k: Column | float) -> Column:
    """Points a game from the lagged seasons by weight, shrunk to ``mu``."""
    lags = range(1, len(weights) + 1)
    points = weighted_sum([F.col(f"prev{n}_points") for n in lags], list(weights))
    games = weighted_sum([F.col(f"prev{n}_games") for n in lags], list(weights))
    return shrink(points, games, mu, k)


def games_estimate(weights: Sequence[float], mu: Column, k: Column | float) -> Column:
    lags = [F.col(f"prev{n}_games") for n in range(1, len(weights) + 1)]
    return shrink(weighted_sum(lags, list(weights)), weight_mass(lags, list(weights)), mu, k)


def finish(df: DataFrame, rate: Column, games: Column, most: float) -> DataFrame:
    """``pred_ppg, pred_games, pred_points``: clamped, and their product."""
    df = df.select("*", clip(rate, 0.0).alias("pred_ppg"), clip(games, 0.0, most).alias("pred_games"))
    return df.withColumn("pred_points", F.col("pred_ppg") * F.col("pred_games"))


def cohort(panel: DataFrame, which: str) -> DataFrame:
    if which == "all":
        return panel
    if which not in ("history", "rookies"):
        raise ValueError(f"no cohort {which}")
    return panel.where(F.col("has_history") == (which == "history"))


def errors(df: DataFrame, by: Sequence[str], pred: str, actual: str) -> DataFrame:
    """``n, rmse, mae`` over pairs without nulls."""
    gap = F.col(pred) - F.col(actual)
    return df.where(gap.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"))


def scores(df: DataFrame, by: Sequence[str], pred: str, actual: str) -> DataFrame:
    return errors(df, by, pred, actual).join(spearman(df, by, pred, actual), list(by), "left")


def residual_quantiles(df: DataFrame, by: Sequence[str], pred: str, actual: str, levels: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    return nearest_quantiles(df.select(*by, (F.col(actual) - F.col(pred)).alias("__r")), by, "__r", levels)


def coverage(df: DataFrame, by: Sequence[str], actual: str, quantiles: Sequence[str]) -> DataFrame:
    """Share of actuals not above each quantile column."""
    return df.groupBy(*by).agg(*[F.avg((F.col(actual) <= F.col(q)).cast("double")).alias(f"cover_{q}") for q in quantiles])


#: Constants that a fit tries, in units of the weights' sum (rates, games), and for points an opportunity.
RATE_GRID = tuple(k * 0.5 for k in range(81))
GAMES_GRID = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
EFFICIENCY_GRID = (0.0, 5.0, 10.0, 20.0, 30.0, 50.0, 75.0, 100.0, 150.0, 200.0, 300.0, 500.0, 750.0, 1000.0, 2000.0, 5000.0)


def grid_errors(total: Column, weight: Column, mu: Column, grid: Sequence[float], actual: Column, volume: Column | None = None) -> Column:
    """Aggregate: the mean squared error of ``shrink`` at each constant, as an array in the grid's order; rows count by ``volume``."""
    by = F.lit(1.0) if volume is None else volume
    return F.array(*[F.avg(F.pow(shrink(total, weight, mu, float(k)) - actual, F.lit(2)) * by) for k in grid])


def best_of(errors: Column, grid: Sequence[float]) -> Column:
    """The first constant with the least error; the first of all where there was nothing to fit."""
    known = F.array(*[F.lit(float(k)) for k in grid])
    return F.coalesce(F.try_element_at(known, F.nullif(F.array_position(errors, F.array_min(errors)).cast("int"), F.lit(0))), F.lit(float(grid[0])))


def by_constant(errors: DataFrame, by: Sequence[str], column: str, grid: Sequence[float]) -> DataFrame:
    """``by, k, mse``: an array of errors as rows."""
    known = F.array(*[F.lit(float(k)) for k in grid])
    return errors.select(*by, F.explode(F.arrays_zip(known.alias("k"), F.col(column).alias("mse"))).alias("e")).select(*by, F.col("e.k").alias("k"), F.col("e.mse").alias("mse"))


def shrink_errors(train: DataFrame, by: Sequence[str], weights: Sequence[float], mu: Column, grid: Sequence[float], actual: Column) -> DataFrame:
    """``k, mse`` for every constant of ``grid``, from one aggregate with map-side sums."""
    lags = range(1, len(weights) + 1)
    points, games = (weighted_sum([F.col(f"prev{n}_{c}") for n in lags], list(weights)) for c in ("points", "games"))
    found = train.groupBy(*by).agg(grid_errors(points, games, mu, grid, actual).alias("errors"))
    return by_constant(found, by, "errors", grid)


def _means(panel: DataFrame, tests: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Mean rate (a ratio of sums) and games of each fold's training rows, by group and over all."""
    known = F.col("games").isNotNull().cast("double")
    return fold_means(panel, tests, {"mu": (F.col("points"), F.col("games")), "games_mu": (F.col("games"), known)})


def _test_rows(panel: DataFrame, tests: Sequence[int]) -> DataFrame:
    return panel.where(F.col("season").isin(*tests)).withColumn("fold", F.col("season"))


def segment_means(panel: DataFrame, tests: Sequence[int], most: float = 17.0) -> DataFrame:
    """Rung 0 in every fold: each group's mean rate and games, from seasons before the fold's."""
    rated = with_means(_test_rows(panel, tests), *_means(panel, tests), ["mu", "games_mu"])
    return finish(rated, F.col("mu"), F.col("games_mu"), most).drop("fold")


def weighted_prior(panel: DataFrame, tests: Sequence[int], weights: Sequence[float], bucket: Column | None = None, most: float = 17.0, strength: float = 20.0) -> DataFrame:
    """Rungs 1 and 2 in every fold: lagged seasons by weight, shrunk to the group's mean by constants fitted before the fold.

    The constants are the best of ``RATE_GRID`` and ``GAMES_GRID``, in units of the
    weights' sum. ``bucket`` (an age bucket, say) adds the mean residual of its rows
    in the group, itself shrunk to 0 as if by ``strength`` more rows. All folds are
    fitted from one aggregate over the panel.
    """
    lags, scale = range(1, len(weights) + 1), float(sum(weights))
    points, games = (weighted_sum([F.col(f"prev{n}_{c}") for n in lags], list(weights)) for c in ("points", "games"))
    mass = weight_mass([F.col(f"prev{n}_games") for n in lags], list(weights))
    grids = [k * scale for k in RATE_GRID], [k * scale for k in GAMES_GRID]
    actual = F.try_divide("points", F.nullif(F.col("games"), F.lit(0.0)))
    own, every = _means(panel, tests)
    rates = Fit(points, games, actual, grids[0])
    sums = before_each_fold(shrink_sums(panel, ["season", "grp"], [rates, Fit(games, mass, F.col("games"), grids[1])]), tests, ["grp", "fit", "place"])
    fitted = best_constants(sums, own, {"k_rate": ("mu", grids[0]), "k_games": ("games_mu", grids[1])})
    test = with_means(_test_rows(panel, tests), own, every, ["mu", "games_mu"])
    test = test.join(F.broadcast(fitted), "fold", "left")  # a row a fold
    test = test.withColumns({"k_rate": F.coalesce("k_rate", F.lit(grids[0][0])), "k_games": F.coalesce("k_games", F.lit(grids[1][0]))})
    rate = shrink(points, games, F.col("mu"), F.col("k_rate"))
    if bucket is not None:
        bucketed = panel.withColumn("__bucket", bucket).where(F.col("__bucket").isNotNull())
        found = before_each_fold(shrink_sums(bucketed, ["season", "grp", "__bucket"], [rates]), tests, ["grp", "__bucket", "fit", "place"])
        known = found.join(F.broadcast(fitted.select("fold", "k_rate_place")), "fold").where(F.col("place") == F.col("k_rate_place")).join(own.select("fold", "grp", "mu"), ["fold", "grp"])
        curve = known.select("fold", "grp", "__bucket", (-(F.col("a") + F.col("b") * F.col("mu")) / (F.col("n") + strength)).alias("adjust"))
        test = test.withColumn("__bucket", bucket).join(curve, ["fold", "grp", "__bucket"], "left").drop("__bucket")
        rate = rate + F.coalesce("adjust", F.lit(0.0))
    return finish(test, rate, shrink(games, mass, F.col("games_mu"), F.col("k_games")), most).drop("fold", "adjust", "k_rate_place", "k_games_place")


def rank_line(panel: DataFrame, tests: Sequence[int], rank: str = "rank", most: float = 17.0) -> DataFrame:
    """Rung 3 in every fold: lines from ``log1p(rank)`` to the rate and to games, for each group by least squares on the seasons before the fold's.

    Only rows with a positive rank are learned from and projected. Groups with
    fewer than three such rows get the mean of all groups' rows; a fold without any
    projects nobody. All folds come from sums by season and group.
    """
    x = F.log1p(F.col(rank).cast("double"))
    some = panel.where(F.col(rank) > 0)
    actual = {"rate": F.try_divide("points", F.nullif(F.col("games"), F.lit(0.0))), "games": F.col("games").cast("double")}
    parts = []
    for name, y in actual.items():
        own = F.when(y.isNotNull(), x)
        parts += [F.count(y).alias(f"{name}_n"), F.sum(own).alias(f"{name}_x"), F.sum(own * own).alias(f"{name}_xx"), F.sum(y).alias(f"{name}_y"), F.sum(own * y).alias(f"{name}_xy")]
    sums = before_each_fold(some.groupBy("season", "grp").agg(*parts), tests, ["grp"])
    lines, every = [], []
    for name in actual:
        n, sx, sxx, sy, sxy = (F.col(f"{name}_{c}") for c in ("n", "x", "xx", "y", "xy"))
        slope = F.when(n >= 3, F.coalesce(F.try_divide(n * sxy - sx * sy, F.nullif(n * sxx - sx * sx, F.lit(0.0))), F.lit(0.0)))
        lines += [slope.alias(f"{name}_slope"), ((sy - slope * sx) / n).alias(f"{name}_start")]
        every.append(F.try_divide(F.sum(sy), F.sum(n)).alias(f"{name}_mean"))
    means = F.broadcast(sums.groupBy("fold").agg(*every))  # a row a fold
    test = _test_rows(some, tests).join(sums.select("fold", "grp", *lines), ["fold", "grp"], "left").join(means, "fold")
    line = lambda name: F.coalesce(F.col(f"{name}_start") + F.col(f"{name}_slope") * x, F.coalesce(f"{name}_mean", F.lit(0.0)))
    return finish(test, line("rate"), line("games"), most).drop("fold", *[f"{n}_{c}" for n in actual for c in ("slope", "start", "mean")])


def with_residual_quantiles(predicted: DataFrame, train: DataFrame, by: Sequence[str] = (), levels: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """``predicted`` with ``pred_q{percent}``: its points and the quantiles of the residuals of ``train``, not below 0."""
    keyed = train.withColumn("__all", F.lit(1))
    found = residual_quantiles(keyed, [*by, "__all"], "pred_points", "points", levels)
    joined = predicted.withColumn("__all", F.lit(1)).join(F.broadcast(found) if not by else found, [*by, "__all"], "left")
    names = [f"q{round(100 * a)}" for a in levels]
    return joined.withColumns({f"pred_{q}": clip(F.col("pred_points") + F.col(q), 0.0) for q in names}).drop("__all", *names)


def default_ladder() -> dict[str, Callable[[DataFrame, Sequence[int]], DataFrame]]:
    """The projectors that every other is held against, by name."""
    return {
        "segment_mean": segment_means,
        "last_season_regressed": lambda panel, tests: weighted_prior(panel, tests, (1.0, 0.0, 0.0)),
        "weighted_prior": lambda panel, tests: weighted_prior(panel, tests, (5.0, 4.0, 3.0)),
    }


def run_walk_forward(panel: DataFrame, tests: Sequence[int], projectors: dict[str, Callable] | None = None, which: str = "history", common: bool = False, key: Sequence[str] = ("entity", "season"), extra: Sequence[str] = ()) -> DataFrame:
    """Predictions of every projector on every fold, long: ``projector`` beside the panel's and the predicted columns.

    Only the scored rows are of the cohort ``which``; all rows train. With ``common``
    a row counts only where every projector has a prediction for it. ``extra`` columns are null where a projector has none.
    """
    long, panel = None, settled(panel)  # every projector reads it several times
    for name, projector in (projectors or default_ladder()).items():
        made = cohort(projector(panel, tests), which)
        more = [F.col(c) if c in made.columns else F.lit(None).cast("double").alias(c) for c in extra]
        own = made.select(*key, "grp", "points", "games", "pred_ppg", "pred_games", "pred_points", *more, F.lit(name).alias("projector"))
        long = own if long is None else long.unionByName(own)
    if not common:
        return long
    n = len(projectors or default_ladder())
    shared = long.where("pred_points IS NOT NULL").groupBy(*key).agg(F.count_distinct("projector").alias("n")).where(F.col("n") == n).select(*key)
    return long.join(shared, list(key), "left_semi")


def score_folds(predictions: DataFrame) -> DataFrame:
    """``projector, season, target, n, rmse, mae``: points, points a game and games of each fold, from one scan."""
    pairs = {"points": ("pred_points", F.col("points")), "ppg": ("pred_ppg", F.try_divide("points", F.nullif(F.col("games"), F.lit(0.0)))), "games": ("pred_games", F.col("games"))}
    stacked = F.array(*[F.struct(F.lit(n).alias("target"), F.col(p).alias("pred"), a.cast("double").alias("actual")) for n, (p, a) in pairs.items()])
    rows = predictions.select("projector", "season", F.explode(stacked).alias("s")).select("projector", "season", "s.*")
    return errors(rows, ["projector", "season", "target"], "pred", "actual")


def summarise(scored: DataFrame) -> DataFrame:
    """``projector, target, n, rmse, mae`` over folds: rows summed, errors averaged."""
    return scored.groupBy("projector", "target").agg(F.sum("n").alias("n"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))


def fold_efficiency_of(rows: DataFrame, panel: DataFrame, tests: Sequence[int], points: str, opportunities: str, weights: Sequence[float] = (5.0, 4.0, 3.0), group: str = "grp") -> DataFrame:
    """Test rows with ``efficiency``: lagged points an opportunity, shrunk to the group's by a constant fitted on the seasons of ``panel`` before their fold, rows counted by their opportunities."""
    lags = range(1, len(weights) + 1)
    total, volume = (weighted_sum([F.col(f"prev{n}_{c}") for n in lags], list(weights)) for c in (points, opportunities))
    own, every = fold_means(panel, tests, {"__mu": (F.col(points), F.col(opportunities))}, group)
    fit = Fit(total, volume, F.col(points) / F.col(opportunities), EFFICIENCY_GRID, F.col(opportunities))
    sums = before_each_fold(shrink_sums(panel.where(F.col(opportunities) > 0), ["season", group], [fit]), tests, [group, "fit", "place"])
    fitted = best_constants(sums, own, {"__k": ("__mu", EFFICIENCY_GRID)}, group).drop("__k_place")
    rated = with_means(_test_rows(rows, tests), own, every, ["__mu"], group).join(F.broadcast(fitted), "fold", "left")  # a row a fold
    return rated.withColumn("efficiency", shrink(total, volume, F.col("__mu"), F.coalesce("__k", F.lit(EFFICIENCY_GRID[0])))).drop("__mu", "__k", "fold")


def efficiency(panel: DataFrame, train: DataFrame, points: str, opportunities: str, weights: Sequence[float] = (5.0, 4.0, 3.0), group: str = "grp") -> DataFrame:
    """``panel`` with ``efficiency`` as ``fold_efficiency_of`` has it, fitted on ``train``."""
    both = train.withColumn("season", F.lit(0)).unionByName(panel.select("*", F.col("season").alias("__season")).withColumn("season", F.lit(1)), allowMissingColumns=True)
    return fold_efficiency_of(both, both, [1], points, opportunities, weights, group).withColumn("season", F.col("__season")).select(*panel.columns, "efficiency")


def season_from_games(games: DataFrame, seasons: DataFrame, by: Sequence[str], points: str = "game_points", most: float = 17.0) -> DataFrame:
    """Season predictions from one row a scheduled game: points of all games, scaled to the games that ``seasons`` (``by, pred_games``) expects, and back to a rate."""
    full = games.groupBy(*by).agg(F.sum(points).alias("__full"), F.count(F.lit(1)).alias("__n"))
    joined = seasons.join(full, list(by), "left")
    share = clip(F.col("pred_games"), 0.0, most)
    total = F.coalesce("__full", F.lit(0.0)) * share / F.coalesce("__n", F.lit(1))
    rate = F.when(share > 0, total / share).otherwise(F.lit(0.0))
    return joined.withColumns({"pred_ppg": rate, "pred_games": share}).withColumn("pred_points", F.col("pred_ppg") * F.col("pred_games")).drop("__full", "__n")


def blend(first: DataFrame, second: DataFrame, weight: float, key: Sequence[str] = ("entity", "season")) -> DataFrame:
    """``first`` with rate and games moved by ``weight`` to those of ``second`` (rows that it lacks stay), and points as their product."""
    other = second.select(*key, F.col("pred_ppg").alias("__p"), F.col("pred_games").alias("__g"))
    mixed = lambda a, b: (1 - weight) * F.col(a) + weight * F.coalesce(b, a)
    out = first.join(other, list(key), "left").withColumns({"pred_ppg": mixed("pred_ppg", "__p"), "pred_games": mixed("pred_games", "__g")})
    return out.withColumn("pred_points", F.col("pred_ppg") * F.col("pred_games")).drop("__p", "__g")


def columns_like(df: DataFrame, first: Sequence[str] = (), last: Sequence[str] = (), kinds: Sequence[str] = ()) -> list[str]:
    """Columns whose name starts or ends so, or whose type is one of ``kinds``, in the table's order."""
    return [n for n, k in df.dtypes if n.startswith(tuple(first)) or n.endswith(tuple(last)) or k in kinds]


def permuted(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``column`` of the row that follows in the order of the key's hash, the first's on the last row."""
    hashed = df.withColumns({"__all": F.lit(1), "__md5": F.md5(F.col(key).cast("string"))}).withColumn("__h", F.conv(F.substring("__md5", 1, 8), 16, 10).cast("bigint"))
    placed = numbered(hashed, ["__all"], ["__h"], ["__md5"], "__nth").drop("__md5", "__h")
    size = F.broadcast(df.agg(F.count(F.lit(1)).alias("__n")).withColumn("__all", F.lit(1)))  # a row
    before = placed.join(size, "__all").withColumn("__nth", F.col("__nth") % F.col("__n") + 1).drop("__all", "__n")
    return before.join(placed.select("__nth", F.col(column).alias(name)), "__nth").drop("__nth")


def board(sources: Sequence[DataFrame], key: Sequence[str], order: Sequence[Column | str], group: str = "grp", most: int | None = None) -> DataFrame:
    """Rows of the first source, then those of each further one whose key is not there yet, with ``rank`` and ``group_rank``; only the first ``most`` if that is given."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more.join(out.select(*key), list(key), "left_anti"), allowMissingColumns=True)
    ranked = overall_rank(out, order, "rank", most)
    return ranked.withColumn("group_rank", F.row_number().over(Window.partitionBy(group).orderBy("rank")))


def design(df: DataFrame, exclude: Sequence[str], starts: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and text columns that a model may see: all but ``exclude`` and those whose names start so, in the table's order."""
    left = [(n, k) for n, k in df.dtypes if n not in exclude and not n.startswith(tuple(starts))]
    numeric = [n for n, k in left if k in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or k.startswith("decimal")]
    return numeric, [n for n, k in left if k == "string"]


def with_codes(df: DataFrame, train: DataFrame, columns: Sequence[str], most: int = 1_000) -> DataFrame:
    """``{column}_code``: the place of each text among the sorted ones of ``train``, from 0; null for what it never saw."""
    for c in columns:
        known = sorted(r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect())
        if len(known) > most:
            raise ValueError(f"{c} has more than {most} values")
        place = F.array_position(F.array(*[F.lit(x) for x in known]).cast("array<string>"), F.col(c)) - 1
        df = df.withColumn(f"{c}_code", F.when(place >= 0, place.cast("double")))
    return df


def engineered_priors(panel: DataFrame, weights: Sequence[float] = (5.0, 4.0, 3.0)) -> DataFrame:
    """Weighted games, points a weighted game (null without any) and plain games of the lagged seasons."""
    lags = range(1, len(weights) + 1)
    games, points = (weighted_sum([F.col(f"prev{n}_{c}") for n in lags], list(weights)) for c in ("games", "points"))
    total = weighted_sum([F.col(f"prev{n}_games") for n in lags], [1.0] * len(weights))
    return panel.withColumns({"prior_games_weighted": games, "prior_ppg": F.when(games > 0, F.try_divide(points, games)), "prior_games_total": total})


def expand_to_games(panel: DataFrame, schedule: DataFrame, team: str = "team", season: str = "season", columns: Sequence[str] = ("week", "opponent")) -> DataFrame:
    """One row a scheduled game of each row's team; rows of teams without a schedule have none."""
    return panel.join(schedule.select(team, season, *columns), [team, season])


def with_coverage(scored: DataFrame, predictions: DataFrame, quantiles: Sequence[str] = ("pred_q10", "pred_q50", "pred_q90"), target: str = "points") -> DataFrame:
    """``scored`` with ``cover_{quantile}`` on the rows of ``target``, null on the others: the share of actuals not above each quantile column, over rows that have it."""
    keys = ["projector", "season"]
    known = lambda q: F.col(target).isNotNull() & F.col(q).isNotNull()
    shares = predictions.groupBy(*keys).agg(*[F.avg(F.when(known(q), (F.col(target) <= F.col(q)).cast("double"))).alias(f"cover_{q}") for q in quantiles])
    return scored.join(shares.withColumn("target", F.lit(target)), [*keys, "target"], "left")


def rookies_only(projector: Callable[[DataFrame, Sequence[int]], DataFrame]) -> Callable[[DataFrame, Sequence[int]], DataFrame]:
    """A projector that learns from rookies alone and projects rookies alone."""
    return lambda panel, tests: projector(panel.where("is_rookie"), tests)


def ordered_quantiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The row's quantile columns in order and not below 0, so that none crosses another."""
    at = F.array_sort(F.array(*[clip(F.col(c), 0.0) for c in columns]))
    return df.withColumn("__q", at).withColumns({c: F.col("__q")[k] for k, c in enumerate(columns)}).drop("__q")


def fit_stages(train: DataFrame, features: dict[str, Sequence[str]], rounds: int = 20, tune_on: Column | None = None) -> dict[str, tuple]:
    """A model for each label of ``features``, with the features of its own."""
    return {label: (fit_trees(train, own, label, rounds, tune_on), list(own)) for label, own in features.items()}


def predict_stages(stages: dict[str, tuple], test: DataFrame, prefix: str = "pred_") -> DataFrame:
    """``test`` with a prediction for each stage, none below 0."""
    for label, (model, own) in stages.items():
        test = predict_trees(model, test, own).withColumn(f"{prefix}{label}", clip(F.col("pred"), 0.0)).drop("pred")
    return test


def _trees(features: Sequence[str], label: str, rounds: int, held_out: str | None = None):
    """Imputation, absence flags and boosted shallow trees.

    The flags carry what native missing-value splits would; monotone limits have no
    counterpart and are left out.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    tuned = {"validationIndicatorCol": held_out, "validationTol": 0.001} if held_out else {}
    trees = GBTRegressor(labelCol=label, predictionCol="pred", maxDepth=3, stepSize=0.1, maxIter=rounds, subsamplingRate=0.8, minInstancesPerNode=30, seed=0, **tuned)
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=[f"{c}_filled" for c in features]),
        VectorAssembler(inputCols=[f"{c}_{x}" for c in features for x in ("filled", "absent")], outputCol="features"),
        trees,
    ]
    return Pipeline(stages=stages)


def _flagged(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}_absent") for c in features]).withColumns({c: F.col(c).cast("double") for c in features})


def fit_trees(train: DataFrame, features: Sequence[str], label: str = "games", rounds: int = 20, tune_on: Column | None = None, least: int = 5):
    """A fitted model. With ``tune_on`` (rows such as the last season's), rounds stop where those rows' error stops falling, and all rows are fitted again with as many."""
    known = _flagged(train.where(F.col(label).isNotNull()), features)
    if tune_on is not None:
        tried = _trees(features, label, rounds, "__held").fit(known.withColumn("__held", F.coalesce(tune_on, F.lit(False))))
        rounds = max(least, len(tried.stages[-1].trees))
    return _trees(features, label, rounds).fit(known)


def predict_trees(model, test: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(_flagged(test, features)).select(*test.columns, "pred")


def importances(model, features: Sequence[str], top: int = 20) -> list[tuple[str, float]]:
    """The features with the greatest gain, those of a feature's absence with it."""
    gains = model.stages[-1].featureImportances.toArray()
    found = [(c, float(gains[2 * k] + gains[2 * k + 1])) for k, c in enumerate(features)]
    return sorted(found, key=lambda x: (-x[1], x[0]))[:top]


def tree_games(train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "games", rounds: int = 20) -> DataFrame:
    """``pred`` on ``test`` by boosted shallow trees; missing values are imputed and flagged."""
    return predict_trees(fit_trees(train, features, label, rounds), test, features)
