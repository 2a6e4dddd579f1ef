"""Point-in-time attachment: the newest feature row strictly before a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import last_before, sliced


def attach_asof(spine: DataFrame, features: DataFrame | dict[str, tuple[DataFrame, Sequence[str]]], by: Sequence[str], key: str, columns: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """``spine`` with ``columns`` of the newest row of ``features`` whose ``key`` is less.

    Several feature tables may be given as ``name: (table, columns)``; all are
    carried in one pass. Whole rows are carried, so a null in the newest row stays
    null. Of rows with one key, the greatest by its columns wins. Given ``most``,
    entities with more rows are cut by ``key`` into slices, which carry the last rows
    of those before them.
    """
    blocks = features if isinstance(features, dict) else {"f": (features, columns)}
    names = list(blocks)
    side = spine.select(*by, F.col(key).alias("__k"), F.lit(1).alias("__side"), F.struct(*spine.columns).alias("__row"))
    for n, (table, own) in blocks.items():
        side = side.unionByName(table.where(F.col(key).isNotNull()).select(*by, F.col(key).alias("__k"), F.lit(2).alias("__side"), F.struct(*own).alias(f"__{n}")), allowMissingColumns=True)
    keys = list(by)
    if most is not None:
        cut = sliced(side, by, "__k", most)
        side, keys = last_before(cut, by, {f"__{n}_before": F.col(f"__{n}") for n in names}, [F.col("__k")]), [*by, "__slice"]
    # at one key the spine's row stands before the features', so it sees only what is older
    w = Window.partitionBy(*keys).orderBy(F.col("__k").asc_nulls_first(), "__side", *[f"__{n}" for n in names]).rowsBetween(Window.unboundedPreceding, 0)
    last = {n: F.last(f"__{n}", ignorenulls=True).over(w) for n in names}
    carried = side.select("__side", "__row", *[(x if most is None else F.coalesce(x, F.col(f"__{n}_before"))).alias(f"__{n}") for n, x in last.items()]).where("__side = 1")
    return carried.select("__row.*", *[F.col(f"__{n}.{c}").alias(c) for n in names for c in blocks[n][1]])


def latest_before(archive: DataFrame, by: Sequence[str], stamp: str, cutoff: Column) -> DataFrame:
    """All rows of the newest snapshot that is not after ``cutoff``, for each of ``by``; the newest stamps are a partial aggregate."""
    open_rows = archive.where(F.col(stamp) <= cutoff)
    newest = open_rows.groupBy(*by).agg(F.max(stamp).alias("__newest")).select(*[F.col(c).alias(f"__{c}") for c in by], "__newest")
    same = [*[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col(stamp) == F.col("__newest")]
    return open_rows.join(newest, same, "left_semi")
