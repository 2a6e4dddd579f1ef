"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Separators of whitespace-delimited words: space, tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_SHIPPED: set[str] = set()
_OPENED: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="cutline-")) / "cutline.zip"  # Spark copies it from here
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a local session gets one of its own; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = Path(tempfile.mkdtemp(prefix="cutline-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; it is deleted when the Python driver ends."""
    if not _OPENED:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/cutline-{what}-{uuid.uuid4().hex[:12]}"
    _OPENED.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _OPENED:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors; with its path, for ``delete``."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def keep(df: DataFrame, what: str) -> DataFrame:
    """``df`` as it was stored."""
    return stored(df, what)[0]


def keep_bucketed(df: DataFrame, what: str, key: str) -> tuple[DataFrame, str]:
    """One row of ``df`` for each ``key``, stored as a table bucketed by it, whose joins on the key don't shuffle it; with the table's name, to be dropped."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(buckets, key).dropDuplicates([key])
    placed.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name), name


def opened() -> int:
    """How many stored tables this driver has; for ``keep_only``."""
    return len(_OPENED)


def keep_only(df: DataFrame, what: str, since: int) -> DataFrame:
    """``df`` as it was stored, and all tables deleted that were stored since ``since``: nothing but the result may still need them."""
    out = keep(df, what)
    for spark, path in _OPENED[since:-1]:
        delete(spark, path)
    del _OPENED[since:-1]
    return out


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: rows with equal texts share one analysis."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text, F.length(text)).alias("k2")]


#: A key with more than this share of the rows is hot; there are fewer such keys than its inverse.
HOT_SHARE = 1 / 2_000


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """``rows`` joined with ``keyed``: unique keys, with the number ``n`` of their rows, both stored.

    Rows of hot keys stay where they are and meet their keys by a broadcast of at
    most ``1 / HOT_SHARE`` rows; the others are shuffled by key.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    hot = keyed.where(F.col(n) > total * HOT_SHARE)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.where(F.col(n) <= total * HOT_SHARE), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)
