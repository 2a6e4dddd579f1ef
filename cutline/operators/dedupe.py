"""Picking one row or value of a group, by an order that leaves no ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def last_by(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` of the whole last row of each group (sums partially before the shuffle)."""
    picked = df.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__last"))
    return picked.select(*by, "__last.*")


def modal_value(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """The most frequent value; ties go to the least."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("__n"))
    best = counts.groupBy(*by).agg(F.min_by(F.col(column), F.struct((-F.col("__n")).alias("n"), F.col(column).alias("v"))).alias(column))
    return best


def crosswalk(df: DataFrame, source: str, target: str) -> DataFrame:
    """One ``target`` for each ``source``: the least."""
    return df.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(source).agg(F.min(target).alias(target))
