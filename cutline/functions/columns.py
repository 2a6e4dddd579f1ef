"""Column factories with null rules written out."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum0(x: Column) -> Column:
    """Sum that is 0 over no rows or only nulls."""
    return F.coalesce(F.sum(x), F.lit(0))


def avg_if(x: Column, where: Column) -> Column:
    return F.avg(F.when(where, x))


def sum_if(x: Column, where: Column) -> Column:
    return sum0(F.when(where, x))


def rate(flag: Column) -> Column:
    """Mean of a boolean; nulls are skipped."""
    return F.avg(flag.cast("double"))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clamp that keeps null (``greatest`` would not)."""
    if low is not None:
        x = F.when(x < low, F.lit(low)).otherwise(x)
    if high is not None:
        x = F.when(x > high, F.lit(high)).otherwise(x)
    return x


def map_value(x: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Replace values by ``mapping``; others stay, or become ``default``."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return F.coalesce(table[x], x if default is None else default)


def shrink(total: Column, weight: Column, mean: Column, k: Column | float) -> Column:
    """Regression to the mean: ``(total + k mean) / (weight + k)``, or the mean where there is no weight."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.when(weight + k > 0, F.try_divide(total + k * mean, weight + k)).otherwise(mean)


def weighted_sum(columns: list[Column], weights: list[float]) -> Column:
    """Sum by weight, where a null column adds nothing."""
    return reduce(add, [F.lit(float(w)) * F.coalesce(c, F.lit(0.0)) for c, w in zip(columns, weights)])


def weight_mass(columns: list[Column], weights: list[float]) -> Column:
    """Weight of the columns that are present."""
    return reduce(add, [F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in zip(columns, weights)])


def piecewise_credit(y: Column) -> Column:
    """1.2 for each unit of loss; of gains the first four in full and the next six at half."""
    return F.when(y < 0, 1.2 * y).otherwise(F.least(y, F.lit(4.0)) + 0.5 * clip(y - 4, 0.0, 6.0))


def schedule_length(year: Column, change: int = 2021, before: int = 16, since: int = 17) -> Column:
    return F.when(year >= change, since).otherwise(before)


def implied_totals(total: Column, spread: Column) -> tuple[Column, Column]:
    """Totals of both sides from a total and the home side's spread."""
    return total / 2 + spread / 2, total / 2 - spread / 2


def steady(x: Column, digits: int = 4) -> Column:
    """Rounded off the exact ties that means of round numbers land on."""
    return F.round(x + 1e-7, digits)
