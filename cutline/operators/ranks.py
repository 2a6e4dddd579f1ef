"""Ranks, order statistics and correlations that no single task has to sort a whole group for.

Rows are counted by (group, value) first. Values are dealt to blocks with about equal
numbers of them, between splitters from a mergeable sketch of each group; a table of
a row a block tells how many rows stand before each, and windows run inside blocks
only. A block is a function of the value alone, so ties are never parted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled
from .slices import place, splitters

#: Blocks of a group's values.
BLOCKS = 256


def _spread(df: DataFrame, by: Sequence[str], column: str, blocks: int) -> DataFrame:
    """``df`` with ``__block``; a group's splitters are joined as a table of a row a group."""
    ends = df.groupBy(*by).agg(splitters(F.col(column), blocks).alias("__ends"))
    return df.join(ends, list(by)).withColumn("__block", place(F.col(column), F.col("__ends"), blocks)).drop("__ends")


def value_ranks(df: DataFrame, by: Sequence[str], column: str, blocks: int = BLOCKS) -> DataFrame:
    """``by, column, n`` (rows with the value), ``before`` (rows of the group with a smaller one) and ``total`` (rows of the group), without nulls."""
    values = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    values = _spread(values, by, column, blocks)
    sizes = values.groupBy(*by, "__block").agg(F.sum("n").alias("__rows"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*by, "__block", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__base"), F.sum("__rows").over(group).alias("total"))
    inside = Window.partitionBy(*by, "__block").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("__inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bases, [*by, "__block"])
    return ranked.select(*by, column, "n", (F.col("__base") + F.col("__inside")).alias("before"), "total")


def average_ranks(df: DataFrame, by: Sequence[str], column: str, name: str, descending: bool = False, blocks: int = BLOCKS) -> DataFrame:
    """``df`` without rows whose ``column`` is null, and with ``name``: the rank, whose ties share their mean."""
    ranks = value_ranks(df, by, column, blocks)
    first = (F.col("total") - F.col("before") - F.col("n")) if descending else F.col("before")
    return df.join(ranks.select(*by, column, (first + (F.col("n") + 1) / 2).alias(name)), [*by, column])


def numbered(df: DataFrame, by: Sequence[str], levels: Sequence[str], order: Sequence[Column | str], name: str, descending: Sequence[str] = (), blocks: int = 64) -> DataFrame:
    """``df`` with ``name``: the row's number from 1 in its group by ``order``, which must be total.

    ``levels`` are numeric columns without nulls that lead ``order`` (those of
    ``descending`` downwards); rows are blocked by the values of all but the last
    and by spans of the last with about equal numbers of rows.
    """
    *exact, last = levels
    spread = _spread(df, by, last, blocks)
    keys = [*exact, "__block"]
    sizes = spread.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("__rows"))
    way = lambda k: F.col(k).desc() if (last if k == "__block" else k) in descending else F.col(k).asc()
    earlier = Window.partitionBy(*by).orderBy(*map(way, keys)).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*by, *keys, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(*by, *keys).orderBy(*order))
    ranked = spread.withColumn("__inside", inside).join(bases, [*by, *keys])
    return ranked.withColumn(name, F.col("__base") + F.col("__inside")).drop("__block", "__inside", "__base")


def nearest_quantiles(df: DataFrame, by: Sequence[str], column: str, levels: Sequence[float], blocks: int = BLOCKS) -> DataFrame:
    """The order statistic at ``round((n - 1) level)`` for each level, as ``q{percent}``."""
    at = lambda a: F.floor((F.col("total") - 1) * a + 0.5)
    holds = lambda a: (F.col("before") <= at(a)) & (at(a) < F.col("before") + F.col("n"))
    ranked = value_ranks(df, by, column, blocks)
    return ranked.groupBy(*by).agg(*[F.max(F.when(holds(a), F.col(column))).alias(f"q{round(100 * a)}") for a in levels])


def moment_correlation(x: Column, y: Column) -> Column:
    """Pearson correlation from moments; null for a constant side or no pairs."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    cov = F.avg(x * y) - F.avg(x) * F.avg(y)
    spread = (F.avg(x * x) - F.avg(x) * F.avg(x)) * (F.avg(y * y) - F.avg(y) * F.avg(y))
    return F.when(spread > 1e-12, cov / F.sqrt(spread))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """``spearman`` of each group; null under three pairs."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ranked = average_ranks(average_ranks(pairs, by, "__x", "__rx"), by, "__y", "__ry")
    return ranked.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= 3, moment_correlation(F.col("__rx"), F.col("__ry"))).alias("spearman"))


def overall_rank(df: DataFrame, order: Sequence[Column | str], name: str, most: int | None = None) -> DataFrame:
    """``df`` with its rows' numbers from 1 by ``order``, which must be total; only the first ``most`` if that is given.

    All rows are sorted by range; each partition then counts on from the rows before it.
    """
    if most is not None:
        return df.orderBy(*order).limit(most).withColumn(name, F.row_number().over(Window.orderBy(*order)))
    placed = settled(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))  # a row a partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return placed.join(F.broadcast(bases), "__part").withColumn(name, F.col("__base") + F.col("__at") - F.col("__first") + 1).drop("__part", "__at", "__first", "__base")
