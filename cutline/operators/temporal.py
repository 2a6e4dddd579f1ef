"""Rolling, to-date and placeholder operators over an entity's ordered rows.

``order`` must make an entity's rows unique. All windows of one call share one
partitioning and order, so a call costs one shuffle and one sort. Given ``most``,
entities with more rows are cut into slices by the first column of ``order`` (see
``slices``), so that one entity's history is many tasks' work; results are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import sliced, sums_before, with_halo


def period_key(year: Column, part: Column) -> Column:
    return year * 100 + part


def _over(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def _rolled(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], ranges: dict[int, tuple[int, int]], most: int | None) -> DataFrame:
    means = lambda w: [F.avg(c).over(w.rowsBetween(*r)).alias(f"{c}_last{n}") for c in columns for n, r in ranges.items()]
    if most is None:
        return df.select("*", *means(_over(by, order)))
    cut = with_halo(sliced(df, by, order[0], most), by, order, max(-r[0] for r in ranges.values()))
    return cut.select("*", *means(_over([*by, "__slice"], order))).where("NOT __copy").drop("__slice", "__copy")


def trailing_mean(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], windows: Sequence[int] = (3, 5, 8), most: int | None = None) -> DataFrame:
    """``{column}_last{w}``: mean of the ``w`` rows before this one."""
    return _rolled(df, by, order, columns, {n: (-n, -1) for n in windows}, most)


def inclusive_mean(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], windows: Sequence[int] = (3, 5, 8), most: int | None = None) -> DataFrame:
    """``{column}_last{w}``: mean of this row and the ``w - 1`` before it; bind it by a strict as-of."""
    return _rolled(df, by, order, columns, {n: (1 - n, 0) for n in windows}, most)


def to_date_mean(df: DataFrame, by: Sequence[str], season: str, order: Sequence[str], columns: Sequence[str], most: int | None = None) -> DataFrame:
    """``{column}_std``: sum so far over rows so far in the season; null where this row's value is."""
    keys, known = [*by, season], df.columns
    if most is not None:
        df = sums_before(sliced(df, keys, order[0], most), keys, {"__rows": F.lit(1), **{f"__{c}_so_far": F.col(c) for c in columns}})
        keys = [*keys, "__slice"]
    w = _over(keys, order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    before = lambda c: F.lit(0) if most is None else F.col(c)
    means = [F.when(F.col(c).isNotNull(), (before(f"__{c}_so_far") + F.sum(c).over(running)) / (before("__rows") + F.row_number().over(w))).alias(f"{c}_std") for c in columns]
    return df.select(*known, *means)


def missed_to_date(df: DataFrame, by: Sequence[str], order: Sequence[str], played: str, name: str, most: int | None = None) -> DataFrame:
    """Rows before this one in which ``played`` is 0."""
    known, keys, before = df.columns, list(by), F.lit(0)
    if most is not None:
        df = sums_before(sliced(df, by, order[0], most), by, {"__missed": 1 - F.col(played)})
        keys, before = [*by, "__slice"], F.col("__missed")
    w = _over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.select(*known, (before + F.coalesce(F.sum(1 - F.col(played)).over(w), F.lit(0))).alias(name))


def changed(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, name: str, most: int | None = None) -> DataFrame:
    """True where ``column`` differs from the row before, and on the first row."""
    flag = lambda w: F.coalesce(F.col(column) != F.lag(column).over(w), F.lit(True)).alias(name)
    if most is None:
        return df.select("*", flag(_over(by, order)))
    cut = with_halo(sliced(df, by, order[0], most), by, order, 1)
    return cut.select("*", flag(_over([*by, "__slice"], order))).where("NOT __copy").drop("__slice", "__copy")


def with_upcoming(df: DataFrame, by: Sequence[str], period: dict[str, int]) -> DataFrame:
    """One more row for each entity at ``period``, with nulls elsewhere."""
    kinds = dict(df.dtypes)
    rows = df.select(*by).distinct().select("*", *[F.lit(v).cast(kinds[k]).alias(k) for k, v in period.items()])
    return df.unionByName(rows, allowMissingColumns=True)
