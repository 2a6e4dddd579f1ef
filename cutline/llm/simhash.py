"""SimHash near-duplicates: a Gray-order hierarchical index over 64-bit fingerprints.

A fingerprint holds, bit by bit, the majority of the XXH64 values of a text's
word shingles. Fingerprints link when at most ``radius`` bits differ; documents
are grouped by reachability.

*Routing.* Distinct fingerprints only. The 64 bits are cut into ``radius + 2``
blocks; two fingerprints within ``radius`` bits agree on at least two whole
blocks, so each fingerprint goes to one bucket per pair of blocks, keyed by those
blocks' bits. No link is lost and no bucket holds all fingerprints.

*Index.* A task sorts a bucket by Gray rank, where neighbours share long masked
patterns, and builds a tree over the order: a node keeps the bits on which its
whole group agrees (mask and pattern), so the shared bits are compared once for
the group, and a search carries the differences that its ancestors added up,
pruning a group as soon as the sum passes the radius. Found links enter a
union-find, and a bucket sends out one link per fingerprint at most (to its
bucket's representative), never all pairs.

*Components.* Alternating large-star and small-star steps over these links, each
written to the shared folder, until nothing changes.

Defined results: a null or empty text, or one without a word, has fingerprint
zero and links like any other; fewer words than a shingle make one shingle of all
of them; rows with equal fingerprints are one node; the component is the
smallest id reachable (a null id only where the component has no other);
repeated rows give repeated rows; an empty table gives an empty table; of the
input's columns only ``id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, keep, ship, stored

BITS = 64
#: Leaves of the index hold up to so many fingerprints.
LEAF = 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of the word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
        stops = (ends - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops[shingle - 1 :])], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, shingle: int = 3) -> DataFrame:
    """``id_col``, ``fp`` (the fingerprint as a signed long) and ``k`` (a hash of the text) of each row."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), batch.column(2)], [id_col, "fp", "k"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text, F.xxhash64(text).alias("__k")).mapInArrow(run, f"`{id_col}` {kind}, fp bigint, k bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """Static hierarchy over distinct fingerprints in Gray order.

    Every node covers a run of the order and keeps the mask of bits on which its
    run agrees, less the bits its ancestors already settled, with their values.
    """

    def __init__(self, values: np.ndarray):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        self.nodes: list[tuple[int, int, int, int, int, int]] = []
        if len(values):
            self._build(0, len(values), 0)

    def _build(self, lo: int, hi: int, settled: int) -> int:
        run = self.values[lo:hi]
        agree = ~int(np.bitwise_or.reduce(run) ^ np.bitwise_and.reduce(run)) & (2**BITS - 1)
        mask = agree & ~settled
        me = len(self.nodes)
        self.nodes.append((mask, int(run[0]) & mask, lo, hi, -1, -1))
        if hi - lo > LEAF:
            # cut where the first bit on which the run disagrees changes: both halves then share more
            free = ~agree & (2**BITS - 1)
            top = np.uint64(1 << (free.bit_length() - 1))
            flips = np.flatnonzero(np.diff((run & top) != 0)) + 1
            mid = lo + int(flips[0])
            left = self._build(lo, mid, settled | agree)
            right = self._build(mid, hi, settled | agree)
            self.nodes[me] = (mask, int(run[0]) & mask, lo, hi, left, right)
        return me

    def links(self, radius: int) -> list[tuple[int, int]]:
        """A spanning set of the links within ``radius``, as places in ``self.values``."""
        parent = list(range(len(self.values)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for at, value in enumerate(self.values.tolist()):
            stack = [(0, 0)]
            while stack:
                node, spent = stack.pop()
                mask, pattern, lo, hi, left, right = self.nodes[node]
                spent += ((value ^ pattern) & mask).bit_count()
                if spent > radius or lo > at:
                    continue
                if left >= 0:
                    stack += [(left, spent), (right, spent)]
                    continue
                near = np.bitwise_count(self.values[lo:hi] ^ np.uint64(value)) <= radius
                for other in np.flatnonzero(near).tolist():
                    a, b = find(at), find(lo + other)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
        return [(x, find(x)) for x in range(len(parent)) if find(x) != x]


def bucket_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints, a spanning set for each bucket."""
    n = radius + 2
    edges = [BITS * k // n for k in range(n + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    pairs = [masks[i] | masks[j] for i, j in combinations(range(n), 2)]
    signed = [m - 2**BITS if m >= 2 ** (BITS - 1) else m for m in pairs]
    routes = F.array(*[F.struct(F.lit(k).alias("which"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(signed)])
    routed = fps.select("fp", F.explode(routes).alias("r")).select("fp", "r.which", "r.part")
    ship(fps.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: pd.DataFrame | None = None  # the last bucket of a batch may go on in the next
        for batch in batches:
            frame = batch if carry is None else pd.concat([carry, batch], ignore_index=True)
            last = (frame["which"] == frame["which"].iloc[-1]) & (frame["part"] == frame["part"].iloc[-1])
            carry = frame[last]
            yield from solve(frame[~last])
        if carry is not None:
            yield from solve(carry)

    def solve(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fp, which, part = (frame[c].to_numpy() for c in ("fp", "which", "part"))
        if len(fp) < 2:
            return
        starts = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (part[1:] != part[:-1])])
        stops = np.r_[starts[1:], len(fp)]
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for lo, hi in zip(starts[stops - starts > 1].tolist(), stops[stops - starts > 1].tolist()):
            index = GrayIndex(fp[lo:hi].view(np.uint64))
            found = np.array(index.links(radius), np.int64).reshape(-1, 2)
            own = index.values.view(np.int64)
            a.append(own[found[:, 0]])
            b.append(own[found[:, 1]])
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return routed.repartition("which", "part").sortWithinPartitions("which", "part", "fp").mapInPandas(run, "a bigint, b bigint")


def components(links: DataFrame, what: str = "links") -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``, by large-star and small-star steps.

    The root is the smallest node of the component.
    """
    spark = links.sparkSession
    current, path = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), what)
    before, last = None, _mark(current)
    while before != last:
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        old = path
        current, path = stored(small, what)
        delete(spark, old)
        before, last = last, _mark(current)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(links: DataFrame) -> tuple:
    """What tells one set of links from another: their number and 128 bits of them, from one small aggregate."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first())


def _labelled(df: DataFrame, id_col: str, text: str, shingle: int, radius: int) -> DataFrame:
    """``id_col, fp, k, root, component_id`` of each row."""
    fps = keep(fingerprints(df, id_col, text, shingle=shingle), "fingerprints")
    nodes = keep(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    rooted = components(bucket_links(nodes.select("fp"), radius))
    named = nodes.join(rooted, nodes.fp == rooted.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``id_col, fingerprint`` (16 hex digits) and ``component_id`` of each row."""
    return _labelled(df, id_col, text, shingle, radius).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_each(df: DataFrame, rooted: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row of ``df`` for each root of ``rooted (id_col, k, root)``: least id, then least text hash, nulls last.

    Of rows equal in both one stays; only those are shuffled with their texts.
    """
    stays = rooted.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("k"))).alias("s"))
    several = rooted.groupBy(id_col, "k").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col(id_col).alias("__id"), F.col("k").alias("__k"))
    stays = stays.select(F.col("s.id").alias("__id"), F.col("s.k").alias("__k"))
    same = lambda side: F.col(id_col).eqNullSafe(side["__id"]) & (F.xxhash64(text) == side["__k"])
    kept = df.join(stays, same(stays), "left_semi")
    order = Window.partitionBy(id_col, F.xxhash64(text)).orderBy(F.lit(0))
    repeated = kept.join(several, same(several), "left_semi").withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")
    return kept.join(several, same(several), "left_anti").unionByName(repeated)


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``df`` for each group: the one with the least id, and of those the least text hash.

    A null id only stays where its group has no other; of equal rows one stays.
    """
    return one_each(df, _labelled(df, id_col, text, shingle, radius), id_col, text)
