"""Values of earlier seasons, by key and never by position, so an absent season stays null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lag_join(df: DataFrame, by: Sequence[str], season: str, columns: Sequence[str], lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """``prev{lag}_{column}`` of season minus lag; ``by`` and ``season`` are unique.

    Frames go by the season's value, so all lags come from one sort of an entity's
    rows and nothing is joined.
    """
    w = Window.partitionBy(*by).orderBy(season)
    return df.select("*", *[F.max(c).over(w.rangeBetween(-n, -n)).alias(f"prev{n}_{c}") for n in lags for c in columns])


def next_season(df: DataFrame, season: str, columns: Sequence[str], prefix: str = "prev_season_") -> DataFrame:
    """``df`` keyed by the season after, with its columns renamed: join it on the key."""
    rest = [c for c in df.columns if c not in columns and c != season]
    return df.select(*rest, (F.col(season) + 1).alias(season), *[F.col(c).alias(prefix + c) for c in columns])
