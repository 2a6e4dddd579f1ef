"""Tables in and out: parquet and CSV, season windows, curation, checks."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)


def table(spark: SparkSession, folder: str, name: str, schema: StructType | str | None = None) -> DataFrame:
    """A stored table; with ``schema`` nothing is read to find it out."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def optional_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """A lookup that may be absent: None then, and callers fall back."""
    return spark.read.schema(schema).csv(path, header=True) if exists(spark, path) else None


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def in_window(df: DataFrame, first: int, last: int, season: str = "season") -> DataFrame:
    """Seasons ``first`` to ``last``, both included; the filter reaches the scan."""
    return df.where(F.col(season).between(first, last))


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    """No rows, with every column: what a source without files gives."""
    return spark.createDataFrame([], schema)


def curate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of ``columns`` that the source has, in their order; a warning names the others."""
    if missing := [c for c in columns if c not in df.columns]:
        log.warning("the source lacks %s", ", ".join(missing))
    return df.select(*[c for c in columns if c in df.columns])


def conform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` in their order; those that the source lacks are null strings."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def clamp_seasons(seasons: Sequence[int], floor: int | None = None) -> list[int]:
    """Seasons that a source has; a warning names those before its first one, and none left is an error."""
    kept = [s for s in seasons if floor is None or s >= floor]
    if dropped := sorted(set(seasons) - set(kept)):
        log.warning("no data before %s: left out %s", floor, ", ".join(map(str, dropped)))
    if not kept:
        raise ValueError(f"no seasons left from {floor} on")
    return kept


def pull(read: Callable[[list[int]], DataFrame], path: str, seasons: Sequence[int], *, floor: int | None = None, columns: Sequence[str] | None = None, schema: StructType | str | None = None) -> str:
    """Read a source's seasons and write them to ``path``; with ``schema``, columns are cast to it."""
    df = read(clamp_seasons(seasons, floor))
    df = curate(df, columns) if columns else df
    if schema is not None:
        wanted = empty(df.sparkSession, schema).schema
        df = require_columns(df, wanted.names).select(*[F.col(f.name).cast(f.dataType) for f in wanted])
    write(df, path)
    return path


def pull_types(read: Callable[[str, list[int]], DataFrame], types: Sequence[str], folder: str, name: str, seasons: Sequence[int], *, floor: int | None = None) -> dict[str, str]:
    """One file for each kind of a source, by kind."""
    return {kind: pull(lambda s, kind=kind: read(kind, s), f"{folder}/{name}_{kind}.parquet", seasons, floor=floor) for kind in types}


def ingest(spark: SparkSession, steps: dict[str, Callable[[], object]], folder: str, *, skip: Sequence[str] = ()) -> dict[str, str]:
    """Run pull steps in order; a failing step is reported and the others go on.

    A step gives the frame to write to its file, or writes by itself and gives what it likes.
    """
    status = {}
    for name, step in steps.items():
        if name in skip:
            status[name] = "skipped"
            continue
        try:
            found = step()
            if isinstance(found, DataFrame):
                write(found, f"{folder}/{name}.parquet")
            status[name] = "ok"
        except Exception as problem:  # noqa: BLE001  the report is what the caller reads
            status[name] = f"failed: {type(problem).__name__}: {str(problem)[:200]}"
    return status


def exit_code(status: dict[str, str]) -> int:
    """0 where every step went well or was left out."""
    return int(any(s.startswith("failed") for s in status.values()))


@contextmanager
def _from_footers(spark: SparkSession) -> Iterator[None]:
    """Within this, least and greatest values and counts of parquet files come from their footers."""
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def footer_counts(spark: SparkSession, path: str, columns: Sequence[str], season: str | None = None) -> DataFrame:
    """``rows, newest`` and the values that aren't null of each column; to be run within ``_from_footers``."""
    df = spark.read.parquet(path)
    newest = F.max(season) if season in df.columns else F.lit(None)
    return df.agg(F.count(F.lit(1)).alias("rows"), newest.alias("newest"), *[F.count(c).alias(f"known_{c}") for c in columns])


def coverage(spark: SparkSession, paths: dict[str, str], columns: dict[str, Sequence[str]] | None = None, season: str = "season") -> dict[str, dict]:
    """Rows, newest season and null counts of each file, all from parquet footers: no column is read."""
    found = {}
    with _from_footers(spark):
        for name, path in paths.items():
            own = list((columns or {}).get(name, ()))
            row = footer_counts(spark, path, own, season).first()
            found[name] = {"rows": row["rows"], "newest": row["newest"], "nulls": {c: row["rows"] - row[f"known_{c}"] for c in own}}
    return found


def last_seasons(spark: SparkSession, paths: dict[str, str], season: str = "season") -> dict[str, int | None]:
    """The newest season of each file, from its footer: shows a pull that fell behind."""
    return {name: found["newest"] for name, found in coverage(spark, paths, season=season).items()}


def console(df: DataFrame, rows: int = 20, digits: int = 2) -> str:
    """The first rows as a table of fixed precision for the console."""
    rounded = df.select(*[F.format_number(c, digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes]).limit(rows).collect()
    cells = [list(df.columns), *[["null" if v is None else str(v) for v in r] for r in rounded]]
    widths = [max(map(len, column)) for column in zip(*cells)]
    return "\n".join("  ".join(v.rjust(n) for v, n in zip(line, widths)) for line in cells)


def market_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, present, nulls`` of each expected column, from one scan."""
    there = [c for c in columns if c in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in there])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in there).alias("present"), (F.col(c) if c in there else F.col("__rows")).alias("nulls")) for c in columns])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row: empty where the grain holds."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(~F.col(column).between(low, high))


def lost_rows(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``before`` that ``after`` lacks."""
    return before.select(*keys).distinct().join(after.select(*keys).distinct(), list(keys), "left_anti")


def null_rates(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_null_rate") for c in columns])
