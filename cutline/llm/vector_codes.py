"""Product-quantiser codes of vectors, with nearest entries found under segment-mean bounds.

Components become integers, vectors are cut into equal parts, and each part has a
codebook that a few rounds of Lloyd's algorithm move. All of it is integer
arithmetic, so results don't depend on partitions, and a lost executor's tasks
give the same sums again.

The nearest entry of a part (ties: the lower index) is found from coarse to fine.
With ``q`` and ``c`` cut into blocks, block means and what they leave over are
orthogonal, so the squared distance is at least

    sum over blocks (sum of q - sum of c)^2 / length  +  (rest of q - rest of c)^2

with the norms of the rests. One block, then two, four and so on down to blocks of
two: at each level the entries whose bound is above the distance of an entry
already measured are dropped (by a slack far above rounding errors, so never a
nearest or an equally near one), and those left get their exact distance.

A round sends sums by (part, entry, component) through one partial aggregation;
the driver only holds the codebooks, whose size is ``entries`` vectors.

Defined results: rows whose vector is null or holds a null or non-finite
component are dropped. Repeated ids and null ids are rows like any other (the
first entries are ordered by id, nulls last, then by vector). With fewer rows
than ``entries`` the codebooks have as many entries as rows; an empty table gives
no rows. Null labels are one label. Other columns are not read. Vectors of
different lengths, lengths that ``parts`` doesn't divide, and components too
large for 64-bit distances raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, keep, ship

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Share of the norms by which a bound may be wrong; double precision errs by less than 1e-13 of them.
SLACK = 1e-9
#: Vectors that are compared with a codebook at a time.
ROWS = 2_048


class SegmentBounds:
    """Nearest entries of one part's codebook (entries x width, integers)."""

    def __init__(self, codebook: np.ndarray):
        self.codebook = codebook
        width = codebook.shape[1]
        self.levels, blocks = [], 1
        while blocks == 1 or blocks <= width // 2:
            starts = np.linspace(0, width, blocks + 1).astype(int)[:-1]
            self.levels.append((starts, np.diff([*starts, width])))
            blocks *= 2
        self.entries = [self._means(codebook, level) for level in self.levels] if width else []
        self.norms = (codebook.astype(float) ** 2).sum(1)

    @staticmethod
    def _means(rows: np.ndarray, level: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of each block divided by the root of its length, and the norm of what the means leave over."""
        starts, lengths = level
        scaled = np.add.reduceat(rows, starts, axis=1) / np.sqrt(lengths)
        rest = (rows.astype(float) ** 2).sum(1) - (scaled**2).sum(1)
        return scaled, np.sqrt(np.maximum(rest, 0))

    def _exact(self, rows: np.ndarray, at: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((rows[at] - self.codebook[entry]) ** 2).sum(1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each row's nearest entry, and how many exact distances of all pairs that took."""
        n = len(rows)
        if not self.entries or not n:
            return np.zeros(n, int), np.zeros(n, np.int64), 0
        slack = SLACK * ((rows.astype(float) ** 2).sum(1)[:, None] + self.norms) + SLACK
        (own, rest), (entries, left) = self._means(rows, self.levels[0]), self.entries[0]
        bound = (own - entries.T) ** 2 + (rest[:, None] - left) ** 2
        every = np.arange(n)
        most = self._exact(rows, every, bound.argmin(1))
        at, entry = np.nonzero(bound - slack <= most[:, None])
        for level, (entries, left) in zip(self.levels[1:], self.entries[1:], strict=True):
            own, rest = self._means(rows, level)
            bound = ((own[at] - entries[entry]) ** 2).sum(1) + (rest[at] - left[entry]) ** 2
            first = np.searchsorted(at, every)  # each row has a pair, its nearest entry's
            least = np.minimum.reduceat(bound, first)
            best = np.flatnonzero(bound == least[at])
            best = best[np.unique(at[best], return_index=True)[1]]
            most = np.minimum(most, self._exact(rows, every, entry[best]))
            going = bound - slack[at, entry] <= most[at]
            at, entry = at[going], entry[going]
        exact = self._exact(rows, at, entry)
        least = np.minimum.reduceat(exact, np.searchsorted(at, every))
        best = np.flatnonzero(exact == least[at])
        best = best[np.unique(at[best], return_index=True)[1]]
        return entry[best], least, len(at)


def _integers(column: pa.Array, width: int, parts: int, scale: int) -> np.ndarray:
    """Vectors (without nulls) as rows x parts x width of integers."""
    if pc.any(pc.not_equal(pc.list_value_length(column), width * parts)).as_py():
        raise ValueError(f"vectors differ in length: {width * parts} and others")
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
    limit = np.sqrt(2.0**60 / max(1, width * parts))
    if len(values) and np.abs(values).max() > limit:
        raise ValueError(f"a component is above {limit / scale:.0f}, too large for 64-bit distances")
    return values.astype(np.int64).reshape(len(column), parts, width)


def _whole(df: DataFrame, vector: str) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(F.col(vector).isNotNull() & F.forall(vector, finite))


def fit_codebooks(df: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts x entries x width) after ``rounds`` rounds over every whole row of ``df``."""
    ship(df.sparkSession)
    rows = _whole(df, vector).select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    first = [r.vector for r in rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()]
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    if len(first[0]) % parts:
        raise ValueError(f"{len(first[0])} components can't be cut into {parts} equal parts")
    width = len(first[0]) // parts
    books = _integers(pa.array(first, pa.list_(pa.float64())), width, parts, scale).transpose(1, 0, 2)
    vectors = rows.select("vector")
    for _ in range(rounds):
        sums = _sums(vectors, books, scale).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        moved = books.copy()
        for r in sums.collect():  # a row a component of the codebooks
            moved[r.part, r.entry, r.place] = r.total // r.n
        books = moved
    return books


def _sums(vectors: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    """Sums and counts of each task's parts by the entry that is nearest, a row a component."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, k, width = books.shape
        bounds = [SegmentBounds(b) for b in books]
        totals, counts = np.zeros_like(books), np.zeros((parts, k), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                rows = _integers(batch.column(0).slice(lo, ROWS), width, parts, scale)
                for p in range(parts):
                    entry, _, _ = bounds[p].nearest(rows[:, p])
                    np.add.at(totals[p], entry, rows[:, p])
                    counts[p] += np.bincount(entry, minlength=k)
        part, entry = np.nonzero(counts)
        if len(part) and width:
            place = np.tile(np.arange(width), len(part))
            columns = [part.repeat(width).astype(np.int32), entry.repeat(width).astype(np.int32), place.astype(np.int32), totals[part, entry].ravel(), counts[part, entry].repeat(width)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "place", "total", "n"])

    return vectors.mapInArrow(run, "part int, entry int, place int, total bigint, n bigint")


def assign_codes(df: DataFrame, books: np.ndarray, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """``id, label, code, error`` of every whole row of ``df`` under given codebooks."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(books)
    rows = _whole(df, vector).select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, _, width = books.shape
        bounds = [SegmentBounds(b) for b in books]
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                own = batch.slice(lo, ROWS)
                rows = _integers(own.column(2), width, parts, scale)
                found = [bounds[p].nearest(rows[:, p]) for p in range(parts)]
                digits = np.stack([f[0] for f in found], 1).astype(np.uint8).tobytes().hex()
                codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(codes, pa.string()), pa.array(sum(f[1] for f in found))], ["id", "label", "code", "error"])

    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(df: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Fit codebooks and encode every whole row: ``id_col, code, error, label_error, codebooks_sha256``."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold up to 256 entries")
    books = fit_codebooks(df, id_col=id_col, vector=vector, parts=parts, entries=entries, rounds=rounds, scale=scale)
    codes = keep(assign_codes(df, books, id_col=id_col, vector=vector, label=label, scale=scale), "codes")
    totals = keep(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    totals = totals.select(F.col("label").alias("of"), "label_error", "n")
    same = F.col("label").eqNullSafe(F.col("of"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    hot, rest = totals.where(F.col("n") > total * HOT_SHARE), totals.where(F.col("n") <= total * HOT_SHARE)  # at most 1 / HOT_SHARE labels are hot
    joined = codes.join(F.broadcast(hot), same).unionByName(codes.join(F.broadcast(hot.select("of")), same, "left_anti").join(rest, same))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same as DuckDB SQL: every round compares each part with every entry."""
    width = f"(SELECT any_value(len(v)) // {PARTS} FROM kept)"
    distance = "list_sum(list_transform(list_zip(x.v, c.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, p, v[p * {width} + 1 : (p + 1) * {width}] AS v FROM kept, range({PARTS}) AS r(p))",
        f"book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT vec_id, x.p AS p, min({{'d': {distance}, 'e': e}}) AS b FROM cut AS x JOIN book{k} AS c ON x.p = c.p GROUP BY vec_id, x.p)")
        if k < ROUNDS:
            sums = f"SELECT n.p, n.b.e AS e, i, sum(x.v[i]) AS s, count(*) AS n FROM near{k} AS n JOIN cut AS x ON x.vec_id = n.vec_id AND x.p = n.p, range(1, {width} + 1) AS r(i) GROUP BY ALL"
            moved = f"SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM ({sums}) GROUP BY p, e"
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM book{k} AS c LEFT JOIN ({moved}) AS m ON m.p = c.p AND m.e = c.e)")
    steps.append(f"done AS (SELECT vec_id, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)")
    digest = f"(SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book{ROUNDS})"
    return f"WITH {', '.join(steps)} SELECT d.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM done AS d JOIN kept AS k ON k.vec_id = d.vec_id"


ORACLE_SQL = _oracle()
