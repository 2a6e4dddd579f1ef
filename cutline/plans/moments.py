"""Fits of all folds from sums that merge: one aggregate over the panel, then tables of a row a season and group.

A fold learns from the seasons before its own, so what it needs of them is a sum over
seasons, and no row of the panel is looked at once a fold. That holds for the shrinkage
constants too: with ``A = total / (weight + k) - actual`` and ``B = k / (weight + k)``
the error of ``shrink`` is ``A + B mean``, whose square needs the sums of ``A A``,
``A B`` and ``B B`` only; the fold's mean comes in afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def before_each_fold(sums: DataFrame, tests: Sequence[int], by: Sequence[str], season: str = "season") -> DataFrame:
    """``fold, *by`` and every other column summed over the seasons before the fold's; ``sums`` has a row a season and key."""
    folds = F.broadcast(sums.sparkSession.createDataFrame([(t,) for t in tests], "fold bigint").select(F.col("fold").cast(dict(sums.dtypes)[season])))
    values = [c for c in sums.columns if c not in (season, *by)]
    joined = sums.join(folds, F.col(season) < F.col("fold"))
    return joined.groupBy("fold", *by).agg(*[F.sum(c).alias(c) for c in values])


@dataclass(frozen=True)
class Fit:
    """A constant to fit: ``shrink(total, weight, mean, k)`` against ``actual``, rows counted by ``volume``."""

    total: Column
    weight: Column
    actual: Column
    grid: Sequence[float]
    volume: Column | None = None


def shrink_sums(rows: DataFrame, by: Sequence[str], fits: Sequence[Fit]) -> DataFrame:
    """``*by, fit, place, aa, ab, bb, a, b, n`` for every constant of every fit (numbered), over rows whose ``actual`` is known.

    The mean squared error is ``(aa + 2 ab mean + bb mean^2) / n``, the mean gap ``(a + b mean) / n``.
    A row meets the constants in place, before the map-side sums.
    """
    own = [(F.col(f"__t{i}"), F.col(f"__w{i}"), F.col(f"__y{i}"), F.col(f"__v{i}")) for i in range(len(fits))]
    given = [(f.total, f.weight, f.actual, F.lit(1.0) if f.volume is None else f.volume) for f in fits]
    base = rows.select(*by, *[x.cast("double").alias(f"__{c}{i}") for i, xs in enumerate(given) for c, x in zip("twyv", xs, strict=True)])
    constants = F.array(*[F.struct(F.lit(i).alias("fit"), F.lit(j).alias("place"), F.lit(float(k)).alias("k")) for i, f in enumerate(fits) for j, k in enumerate(f.grid)])
    long = base.withColumn("__k", F.explode(constants)).select("*", "__k.*")

    def chosen(which: int) -> Column:
        out = own[0][which]
        for i in range(1, len(fits)):
            out = F.when(F.col("fit") == i, own[i][which]).otherwise(out)
        return out

    long = long.select(*by, "fit", "place", "k", *[chosen(i).alias(c) for i, c in enumerate("twyv")]).where("y IS NOT NULL")
    some = F.col("w") + F.col("k") > 0
    a = F.when(some, F.try_divide(F.col("t"), F.col("w") + F.col("k"))).otherwise(0.0) - F.col("y")
    b = F.when(some, F.try_divide(F.col("k"), F.col("w") + F.col("k"))).otherwise(1.0)
    long = long.select(*by, "fit", "place", "v", a.alias("a"), b.alias("b"))
    a, b, v = F.col("a"), F.col("b"), F.col("v")
    sums = {"aa": a * a * v, "ab": a * b * v, "bb": b * b * v, "a": a, "b": b}
    return long.groupBy(*by, "fit", "place").agg(*[F.sum(x).alias(c) for c, x in sums.items()], F.count(F.lit(1)).alias("n"))


def fold_means(panel: DataFrame, tests: Sequence[int], means: dict[str, tuple[Column, Column]], group: str = "grp") -> tuple[DataFrame, DataFrame]:
    """Ratios of sums by fold and group, and by fold alone; ``means`` has a numerator and a denominator for each name."""
    parts = [x for name, (top, bottom) in means.items() for x in (F.sum(top).alias(f"{name}__top"), F.sum(bottom).alias(f"{name}__bottom"))]
    sums = before_each_fold(panel.groupBy("season", group).agg(*parts), tests, [group])
    ratio = lambda name, x: F.try_divide(x(f"{name}__top"), x(f"{name}__bottom")).alias(name)
    every = sums.groupBy("fold").agg(*[ratio(n, F.sum) for n in means])
    return sums.select("fold", group, *[ratio(n, F.col) for n in means]), every


def with_means(rows: DataFrame, own: DataFrame, every: DataFrame, names: Sequence[str], group: str = "grp") -> DataFrame:
    """``rows`` (with ``fold``) with the means of their group in their fold; those of all rows for a group that has none."""
    other = F.broadcast(every.select("fold", *[F.col(n).alias(f"__{n}") for n in names]))  # a row a fold
    joined = rows.join(own.select("fold", group, *names), ["fold", group], "left").join(other, "fold", "left")
    return joined.withColumns({n: F.coalesce(n, f"__{n}") for n in names}).drop(*[f"__{n}" for n in names])


def best_constants(sums: DataFrame, own: DataFrame, fits: dict[str, tuple[str, Sequence[float]]], group: str = "grp") -> DataFrame:
    """A row a fold: the first constant with the least error for each of ``fits`` (name to the mean's column in ``own`` and the grid, in the order of ``shrink_sums``).

    Folds without rows have the first constant; ``{name}_place`` is its place.
    """
    joined = sums.join(own, ["fold", group])
    mean = F.lit(None).cast("double")
    for i, (column, _) in enumerate(fits.values()):
        mean = F.when(F.col("fit") == i, F.col(column)).otherwise(mean)
    square = F.col("aa") + 2 * mean * F.col("ab") + mean * mean * F.col("bb")
    errors = joined.groupBy("fold", "fit", "place").agg(F.try_divide(F.sum(square), F.sum("n")).alias("e"))
    least = lambda i: F.min_by("place", F.when((F.col("fit") == i) & F.col("e").isNotNull(), F.struct("e", "place")))
    first = errors.groupBy("fold").agg(*[F.coalesce(least(i), F.lit(0)).alias(f"{name}_place") for i, name in enumerate(fits)])
    known = {name: F.get(F.array(*[F.lit(float(k)) for k in grid]), F.col(f"{name}_place")) for name, (_, grid) in fits.items()}
    return first.withColumns(known)
