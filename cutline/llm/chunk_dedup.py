"""Substring dedup: content-defined chunks by a gear rolling hash, told apart by digest.

A text's bytes are cut where the gear hash of the last ``HASHED`` bytes ends in
zero bits, never closer than ``LEAST`` and never farther than ``MOST``; what stands
before a cut doesn't matter, so an insertion moves the cuts around it and leaves
the others. Every chunk has a 64-bit digest with its length. A chunk whose digest
occurs in more than one place is *repeated*; the first place by (id, text hash,
start) keeps it. Of the others, runs of neighbouring repeated chunks that hold
``RUN`` bytes or more are removed; shorter ones are chance and stay.

Shuffles: a count of digests, with map-side sums; the chunks by digest against the
repeated ones, where chunks of hot digests stay in place and meet a broadcast of a
bounded number of digests (``hot_join``); the removed spans by row. Texts are
shuffled once, for the removal.

Defined results: texts are UTF-8; a null or empty text has no chunks and loses
nothing; a row with a null id comes before others; rows equal in id and text are
one place and get one result each; an empty table gives an empty table; columns
that clash with an added name are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, keep, ship
from .suffix_dedup import merge_spans

LEAST, MOST = 24, 256
#: Zero bits that end a chunk: 32 bytes on average beyond the least; and bytes that the hash holds.
ZEROS, HASHED = 5, 16
RUN = 80


def _gear() -> np.ndarray:
    """A number for each byte, by a rule."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 1) & 0xFFFF for b in range(256)], np.uint16)


_GEAR = _gear()


def gear_hashes(raw: bytes) -> np.ndarray:
    """``h = (h << 1) + gear[byte]`` in 16 bits after each byte, all places at once by doubling."""
    h = _GEAR[np.frombuffer(raw, np.uint8)]
    done = 1
    while done < HASHED:
        h[done:] = h[done:] + (h[:-done] << np.uint16(done))
        done *= 2
    return h


def cut_points(raw: bytes) -> list[int]:
    """Ends of the chunks of ``raw``."""
    n = len(raw)
    ends = (np.flatnonzero(gear_hashes(raw) >> np.uint16(16 - ZEROS) == 0) + 1).tolist() if n else []
    out, last, k = [], 0, 0
    while last < n:
        while k < len(ends) and ends[k] < last + LEAST:
            k += 1
        end = ends[k] if k < len(ends) else n
        last = min(end, last + MOST, n)
        out.append(last)
    return out


CHUNK = "digest bigint, id {kind}, k bigint, seq int, start int, size int"


def _chunks(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                at, digests, seq, starts, sizes = [], [], [], [], []
                for i, value in enumerate(part.column(2).to_pylist()):
                    raw = value.encode("utf-8", "surrogatepass")
                    last = 0
                    ends = cut_points(raw)
                    for end in ends:
                        digests.append(xxhash.xxh3_64_intdigest(raw[last:end], end - last))
                        starts.append(last)
                        sizes.append(end - last)
                        last = end
                    at += [i] * len(ends)
                    seq += range(len(ends))
                rows = pa.array(at, pa.int64())
                columns = [
                    pa.array(np.array(digests, np.uint64).view(np.int64)),
                    part.column(0).take(rows),
                    part.column(1).take(rows),
                    pa.array(seq, pa.int32()),
                    pa.array(starts, pa.int32()),
                    pa.array(sizes, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "id", "k", "seq", "start", "size"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.where(F.octet_length(text) > 0).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k"), text)
    return rows.mapInArrow(run, CHUNK.format(kind=kind))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, k, chunks`` of rows that have repeated chunks other than at their first place: (seq, start, end)."""
    ship(docs.sparkSession)
    chunks = keep(_chunks(docs, id_col, text), "chunks")
    twice = keep(chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-digests")
    some = keep(hot_join(chunks, twice, ["digest"]).drop("n"), "repeated-chunks")
    first = keep(some.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "k", "seq")).alias("first")), "first-places")
    later = hot_join(some, first, ["digest"]).where(~F.struct("id", "k", "seq").eqNullSafe(F.col("first")))
    return later.groupBy("id", "k").agg(F.collect_set(F.struct("seq", "start", (F.col("start") + F.col("size")).alias("end"))).alias("chunks"))


def long_runs(chunks: list[tuple[int, int, int]], least: int) -> list[tuple[int, int]]:
    """Runs of neighbouring chunks (seq, start, end) that hold ``least`` bytes, as (start, end)."""
    return [(a, b) for a, b in merge_spans([(a, b) for _, a, b in chunks]) if b - a >= least]


ADDED = "n_bytes bigint, n_repeated_chunks bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, run_bytes: int = RUN, with_text: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes, n_repeated_chunks, n_removed, n_spans, kept_sha256`` and, if asked for, ``clean_text``.

    ``clean_text`` is what is left, decoded; parts of characters that a cut parted
    are left out there.
    """
    names = ["n_bytes", "n_repeated_chunks", "n_removed", "n_spans", "kept_sha256"] + ["clean_text"] * with_text
    rest = [c for c in docs.columns if c not in names]
    base = docs.select(*rest)
    found = repeated_chunks(base, id_col, text).select(F.col("id").alias("__id"), F.col("k").alias("__k"), F.col("chunks").alias("__chunks"))
    joined = base.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__k")), "left").select(*rest, "__chunks")
    at, n = rest.index(text), len(rest)
    out = rest if with_text else [c for c in rest if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, chunks in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist()):
                raw = (value or "").encode("utf-8", "surrogatepass")
                spans = long_runs([(c["seq"], c["start"], c["end"]) for c in chunks or []], run_bytes)
                left, done = [], 0
                for a, b in spans:
                    left.append(raw[done:a])
                    done = b
                kept = b"".join([*left, raw[done:]])
                row = (len(raw), len(chunks or []), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                rows.append((*row, value if not spans else kept.decode("utf-8", "ignore")) if with_text else row)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            more = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(rest.index(c)) for c in out), *more], [*out, *names])

    kinds = dict(base.dtypes)
    return joined.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in out] + [ADDED] + ["clean_text string"] * with_text))
