"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on ids.

Documents are dealt out by ranges of their id, sorted, encoded and written, one
file a range; ORC stores the ids with integer run-length encoding in stripes,
which tasks read in parallel, and each stripe has a row index (least and greatest
values) and a Bloom filter on the document id, so a filter on ids skips files,
stripes and row groups by their metadata.

A file's rows: the id, ``part`` (the file's number, in the order of the ranges),
``offset`` (token ids before it in the file), ``ids`` with the end id, and ``n_ids``,
their number, so that a file's ids are counted without decoding them.

Defined results: a null or empty text is the end id alone; rows with a null id
come first; equal ids are ordered by text, equal rows are kept; an empty table
gives a table without rows; of the input only id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship
from .tokens import document_ids

STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1_000
BLOOM_FPP = 0.01


def write_token_files(df: DataFrame, path: str, vocabulary: str, *, id_col: str = "doc_id", text: str = "text", end: int = 0) -> None:
    """Encode every row's text and write the ids below ``path`` in ascending id order."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset, which = 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [document_ids(vocabulary, x, end) for x in part.column(1).to_pylist()]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                number = pa.array(np.full(len(ids), which, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), number, pa.array(offset + bounds[:-1]), lists, pa.array(sizes)], [id_col, "part", "offset", "ids", "n_ids"])
                offset += int(bounds[-1])

    kind = dict(df.dtypes)[id_col]
    ordered = df.select(id_col, text).repartitionByRange(id_col).sortWithinPartitions(id_col, text)
    options = {
        "compression": "zstd",
        "orc.stripe.size": str(STRIPE_BYTES),
        "orc.create.index": "true",
        "orc.row.index.stride": str(ROW_INDEX_STRIDE),
        "orc.bloom.filter.columns": id_col,
        "orc.bloom.filter.fpp": str(BLOOM_FPP),
    }
    ordered.mapInArrow(run, f"`{id_col}` {kind}, part int, offset bigint, ids array<int>, n_ids bigint").write.options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files, with the id's own type; filters on the id prune by metadata."""
    return spark.read.orc(path)


def token_digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` of every document in the files.

    ``start`` counts the ids of all documents before it, over all files.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(bounds).astype(np.int64)), pa.array(crcs, pa.int64())], [id_col, "part", "offset", "n_tokens", "ids_crc32"])

    kind = dict(rows.dtypes)[id_col]
    digests = rows.select(id_col, "part", "offset", "ids").mapInArrow(run, f"`{id_col}` {kind}, part int, offset bigint, n_tokens bigint, ids_crc32 bigint")
    n_ids = F.col("n_ids") if "n_ids" in rows.columns else F.size("ids").cast("long")  # files written before have none
    sizes = rows.groupBy("part").agg(F.sum(n_ids).alias("n"))  # a row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return digests.join(bases, "part").select(id_col, (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
