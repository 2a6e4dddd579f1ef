"""Tables stored by the hash of their keys, so that joins on them need no shuffle.

Blocks that are joined again and again are written once, bucketed and sorted by
(entity, season). Tables with equal numbers of buckets then meet bucket by bucket,
also where the join has further keys, such as the week.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof


def co_located(spark: SparkSession) -> None:
    """Let joins on more keys than the buckets' use the buckets as they are."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def store_bucketed(df: DataFrame, by: Sequence[str], buckets: int, order: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """``df`` as a table in the warehouse, bucketed by ``by`` and sorted in each bucket. Sized for buckets that a task holds: more of them for larger tables, equal numbers for tables that meet."""
    name = name or f"cutline_{uuid.uuid4().hex[:12]}"
    by = list(by)
    df.repartition(buckets, *by).write.mode("overwrite").format("parquet").bucketBy(buckets, *by).sortBy(*by, *order).saveAsTable(name)
    return df.sparkSession.table(name)


def on_keys(spine: DataFrame, features: DataFrame, entity: Sequence[str], season: str, period: str, columns: Sequence[str], buckets: int, most: int | None = None) -> DataFrame:
    """An as-of block as a stored table on the spine's own keys: the newest row strictly before each period, so that later joins are on equal keys."""
    keys = spine.select(*entity, season, period)
    return store_bucketed(asof.attach_asof(keys, features, entity, period, columns, most), [*entity, season], buckets, [period])


def assemble(spine: DataFrame, entity: Sequence[str], season: str, period: str, blocks: Sequence[DataFrame], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Stored ``blocks`` joined to the stored ``spine``: those with ``period`` on it, those without on (entity, season). No table is shuffled where all are bucketed alike."""
    co_located(spine.sparkSession)
    out = spine
    for block in blocks:
        keys = [*entity, season, *([period] if period in block.columns else [])]
        out = out.join(block.hint("merge"), keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (defaults or {}).items()})
