"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from ``spark.checkpoint.dir`` from then on; a lost executor costs no recomputation of what came before.

    Where that is unset a local session gets a folder of its own; a cluster must name one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = Path(tempfile.mkdtemp(prefix="cutline-")).as_uri()
        context.setCheckpointDir(folder)
    return df.checkpoint()
