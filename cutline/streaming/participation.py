"""Participation over an event stream: counts of entities and events a tumbling window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def participation(events: DataFrame, time: str = "ts", entity: str = "user_id", value: str = "value", *, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``start, entity, n_events, total`` for each window and entity; rows later than ``late`` are left out.

    The same expression serves batch and stream; state is dropped behind the watermark.
    """
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    grouped = stamped.groupBy(F.window("__t", window).alias("w"), F.col(entity))
    return grouped.agg(F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), entity, "n_events", "total")
