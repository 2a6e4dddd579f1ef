"""Validation of built tables: each check gives a frame of violations, empty where all is well."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differs(built: DataFrame, again: DataFrame, key: Sequence[str], column: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose ``column`` was computed anew with another value, or on one side only."""
    both = built.select(*key, F.col(column).alias("built")).join(again.select(*key, F.col(column).alias("again")), list(key), "full")
    same = F.col("built").eqNullSafe(F.col("again")) | (F.abs(F.col("built") - F.col("again")) <= tolerance)
    return both.where(~F.coalesce(same, F.lit(False)))


def shares_sum_to_one(df: DataFrame, by: Sequence[str], share: str, tolerance: float = 1e-9) -> DataFrame:
    """Groups whose shares sum neither to 1 nor, where nothing was there to share, to 0."""
    total = df.groupBy(*by).agg(F.sum(share).alias("total"))
    return total.where((F.abs(F.col("total") - 1) > tolerance) & (F.abs(F.col("total")) > tolerance))


def null_rate_above(df: DataFrame, by: Sequence[str], column: str, most: float = 0.05) -> DataFrame:
    """Groups in which more than ``most`` of the rows lack ``column``."""
    return df.groupBy(*by).agg(F.avg(F.col(column).isNull().cast("double")).alias("null_rate")).where(F.col("null_rate") > most)


def means_outside(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``column, mean`` of columns whose mean is not within its range; from one scan."""
    means = df.agg(*[F.avg(c).alias(c) for c in ranges])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("mean"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for c, (a, b) in ranges.items()])
    return means.select(F.explode(rows).alias("r")).select("r.*").where(~F.coalesce(F.col("mean").between(F.col("low"), F.col("high")), F.lit(False)))


def forbidden_columns(df: DataFrame, names: Sequence[str] = (), starts: Sequence[str] = ()) -> list[str]:
    """Columns that a design must not hold: outcomes, or what is known only later."""
    return [c for c in df.columns if c in names or c.startswith(tuple(starts))]


def lag_mismatch(panel: DataFrame, by: Sequence[str], season: str, column: str, lag: int = 1, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose ``prev{lag}_{column}`` is not the value ``lag`` seasons before."""
    moved = panel.select(*by, (F.col(season) + lag).alias(season), F.col(column).alias("want"))
    found = panel.select(*by, season, F.col(f"prev{lag}_{column}").alias("found")).join(moved, [*by, season], "left")
    same = F.col("found").eqNullSafe(F.col("want")) | (F.abs(F.col("found") - F.col("want")) <= tolerance)
    return found.where(~F.coalesce(same, F.lit(False)))


def moved_by(first: DataFrame, second: DataFrame, key: Sequence[str], column: str, tolerance: float = 1e-9) -> DataFrame:
    """Predictions that changed though only what they must not see did (outcomes of their own season, say)."""
    return differs(first, second, key, column, tolerance)


def not_narrower(df: DataFrame, raw: str, shrunk: str, least: float = 0.9) -> DataFrame:
    """One row where shrinkage does not narrow the spread, or reorders too much."""
    found = df.agg(F.stddev(raw).alias("raw"), F.stddev(shrunk).alias("shrunk"), F.corr(raw, shrunk).alias("correlation"))
    return found.where(~F.coalesce((F.col("shrunk") < F.col("raw")) & (F.col("correlation") > least), F.lit(False)))


def not_better(scored: DataFrame, better: str, floor: str, metric: str = "rmse", by: Sequence[str] = ("season",)) -> DataFrame:
    """Folds in which one projector's error is not below another's."""
    one, two = (scored.where(F.col("projector") == p).select(*by, F.col(metric).alias(n)) for p, n in ((better, "one"), (floor, "two")))
    return one.join(two, list(by)).where(F.col("one") >= F.col("two"))


def broken_predictions(df: DataFrame, most: float = 17.0, tolerance: float = 1e-9) -> DataFrame:
    """Rows with games outside 0 to ``most``, a negative rate, or points that are not their product."""
    fine = F.col("pred_games").between(0, most) & (F.col("pred_ppg") >= 0) & (F.abs(F.col("pred_points") - F.col("pred_ppg") * F.col("pred_games")) <= tolerance)
    return df.where(~F.coalesce(fine, F.lit(False)))


def wrong_flags(panel: DataFrame, rookie: Column) -> DataFrame:
    """Rows whose ``is_rookie`` is not what defines it, and rookies with history."""
    return panel.where((F.col("is_rookie") != F.coalesce(rookie, F.lit(False))) | (F.col("is_rookie") & F.col("has_history")))


def coverage_gap(upcoming: DataFrame, played: DataFrame, column: str, most: float = 0.01) -> DataFrame:
    """One row where an upcoming season lacks ``column`` more often than a played one does, by more than ``most``."""
    rate = lambda df, n: df.agg(F.avg(F.col(column).isNull().cast("double")).alias(n)).withColumn("__one", F.lit(1))
    return rate(upcoming, "upcoming").join(rate(played, "played"), "__one").drop("__one").where(F.col("upcoming") > F.col("played") + most)


def changed_row_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row where attaching blocks changed the number of rows."""
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n)).withColumn("__one", F.lit(1))
    return count(before, "before").join(count(after, "after"), "__one").drop("__one").where("before <> after")


def asof_not_strict(attached: DataFrame, key: str, source_key: str) -> DataFrame:
    """Rows whose features are of their own period or later."""
    return attached.where(F.col(source_key) >= F.col(key))


def gate(violations: Mapping[str, DataFrame | Sequence]) -> dict[str, int]:
    """How many violations each check has; the caller exits with an error where any is above 0."""
    return {n: v.count() if isinstance(v, DataFrame) else len(v) for n, v in violations.items()}


def standard(panel: DataFrame, predictions: DataFrame, scored: DataFrame, floor: str, by: Sequence[str] = ("entity",), season: str = "season") -> dict[str, DataFrame]:
    """The checks that any walk-forward run must pass."""
    return {
        "lags": lag_mismatch(panel, by, season, "points"),
        "predictions": broken_predictions(predictions),
        **{f"{p} above {floor}": not_better(scored.where("target = 'points'"), p, floor) for p in (r[0] for r in scored.select("projector").distinct().collect()) if p != floor},
    }

