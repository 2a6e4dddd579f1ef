"""Entities with very many rows, cut by time so that no task holds a whole one.

``sliced`` numbers the slices of large entities: spans of their time key with about
equal numbers of rows, told by a mergeable sketch. What a window needs of the slices
before a row is small: the last ``w`` rows of them (``with_halo``), or sums so far
(``sums_before``), or the last row that has a value (``last_before``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of a large entity.
PIECES = 256
#: At most the inverse of this many entities are large, so their splitters may be broadcast (4 MB).
SHARE = 1 / 2_000


def splitters(x: Column | str, pieces: int) -> Column:
    """Aggregate: ascending values that cut the rows into about ``pieces`` equal parts, from a mergeable sketch."""
    return F.array_distinct(F.percentile_approx(x, [k / pieces for k in range(1, pieces)], 100 * pieces))


def place(x: Column, ends: Column, pieces: int) -> Column:
    """How many of the ascending ``ends`` are less than ``x``, by bisection; 0 for nulls."""

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        up = (at["low"] < at["high"]) & F.coalesce(F.get(ends, middle) < x, F.lit(False))
        return F.struct(F.when(up, middle + 1).otherwise(at["low"]).alias("low"), F.when(up, at["high"]).otherwise(F.least(middle, at["high"])).alias("high"))

    first = F.struct(F.lit(0).alias("low"), F.coalesce(F.size(ends), F.lit(0)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(pieces.bit_length())), first, halve, lambda at: at["low"])


def sliced(df: DataFrame, by: Sequence[str], key: str, most: int, name: str = "__slice", pieces: int = PIECES) -> DataFrame:
    """``df`` with ``name``: the slice of rows of entities with over ``most`` rows (or ``SHARE`` of all, if that is more), -1 for all others.

    Rows with equal keys stay together; null keys are in the first slice.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    large = [tuple(r[c] for c in by) for r in counts.where(F.col("__n") > max(most, total * SHARE)).collect()]  # 1 / SHARE rows at most
    if not large:
        return df.withColumn(name, F.lit(-1))
    schema = df.select(*by).schema
    own = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    keys = df.sparkSession.createDataFrame(large, schema).toDF(*[f"__{c}" for c in by])
    ends = df.join(F.broadcast(keys), own, "left_semi").groupBy(*by).agg(splitters(F.col(key), pieces).alias("__ends")).withColumnsRenamed({c: f"__{c}" for c in by})
    joined = df.join(F.broadcast(ends), own, "left")
    return joined.withColumn(name, F.when(F.col("__ends").isNull(), -1).otherwise(place(F.col(key), F.col("__ends"), pieces))).drop("__ends", *[f"__{c}" for c in by])


def with_halo(df: DataFrame, by: Sequence[str], order: Sequence[str], width: int, name: str = "__slice") -> DataFrame:
    """``df`` with ``__copy``, and for each slice a copy of the entity's last ``width`` rows before it."""
    back = Window.partitionBy(*by, name).orderBy(*[F.col(c).desc() for c in order])
    tails = df.where(F.col(name) >= 0).withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= width).drop("__back")
    tails = tails.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(name, *order)))  # a few rows a slice
    starts = tails.groupBy(*by, name).agg(F.min("__at").alias("__start")).select(*[F.col(c).alias(f"__{c}") for c in by], F.col(name).alias("__to"), "__start")
    near = (F.col("__at") < F.col("__start")) & (F.col("__at") >= F.col("__start") - width)
    copies = tails.join(starts, [*[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], near])
    copies = copies.withColumn(name, F.col("__to")).select(*df.columns).withColumn("__copy", F.lit(True))
    return df.withColumn("__copy", F.lit(False)).unionByName(copies)


def _before(df: DataFrame, by: Sequence[str], name: str, found: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """``df`` with columns of the slices before each row's: ``found`` aggregates a slice, ``carried`` runs over the slices before."""
    each = df.where(F.col(name) >= 0).groupBy(*by, name).agg(*[x.alias(c) for c, x in found.items()])
    w = Window.partitionBy(*by).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    bases = each.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(name).alias("__of"), *[x.over(w).alias(c) for c, x in carried.items()])
    same = [*[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col(name) == F.col("__of")]
    return df.join(bases, same, "left").drop("__of", *[f"__{c}" for c in by])


def sums_before(df: DataFrame, by: Sequence[str], columns: dict[str, Column], name: str = "__slice") -> DataFrame:
    """``df`` with each of ``columns`` summed over the slices before the row's (0 where there are none)."""
    out = _before(df, by, name, {c: F.sum(x) for c, x in columns.items()}, {c: F.sum(c) for c in columns})
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in columns})


def last_before(df: DataFrame, by: Sequence[str], columns: dict[str, Column], order: Sequence[Column], name: str = "__slice") -> DataFrame:
    """``df`` with the last value of each of ``columns`` that isn't null in the slices before the row's, by ``order``."""
    found = {c: F.max_by(x, F.when(x.isNotNull(), F.struct(*order, x))) for c, x in columns.items()}
    return _before(df, by, name, found, {c: F.last(c, ignorenulls=True) for c in columns})
