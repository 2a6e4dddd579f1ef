"""Best-fit packing by patterns: non-negative least squares on the length histogram.

1. Every text becomes token ids with an end id; longer ones than ``capacity`` are
   cut into full pieces and a rest. A full piece is a sequence of its own.
2. The histogram of the other lengths (``capacity`` numbers at most) goes to the
   driver. Lengths are binned to multiples of ``grain``; patterns of one to three
   bins that occur are enumerated, each pair with the largest third bin that still
   fits, so patterns may leave room. Repeat counts are fitted to the binned
   histogram, and their sum to the least possible number of sequences, by
   non-negative least squares (active set), then rounded down.
3. A pattern is filled with exact lengths, longest of each bin first, and whatever
   room is left by best fit; then the residual lengths are packed by best fit
   decreasing. Where best fit decreasing of the whole histogram needs fewer
   sequences, that is taken. All of this moves *runs*: so many sequences of equal
   make-up at once, a few thousand rows at most whatever the corpus.
4. Pieces of a length are numbered and joined to the runs' slots, which gives
   sequence and offset.

Numbering is done in buckets of about ``BUCKET_ROWS`` pieces of a length, so that
one frequent length is no single task's work; their offsets come from a count table
of a row a bucket.

Defined results: a null or empty text is one piece, the end id; repeated rows are
packed each; ids may be null; an empty table gives an empty table; of the input
only id and text are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, ship
from .tokens import document_ids, forget

CAPACITY = 2048
GRAIN = 16
#: Pieces of one length that a bucket of the numbering holds, on average.
BUCKET_ROWS = 100_000


def pieces(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, units: int | None = None) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` of every piece, and ``salt``, which deals even equal rows apart.

    With ``units`` a worker remembers no more of them a generation, and nothing
    once a task has ended: for jobs whose other stages need its memory.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for at, value in enumerate(batch.column(1).to_pylist()):
                ids = memoryview(document_ids(vocabulary, value, end, units))
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((at, piece, start, len(part) // 4, zlib.crc32(part)))
            at, *rest = zip(*rows) if rows else [()] * 5
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(rest[0], pa.int32()), *(pa.array(c, pa.int64()) for c in rest[1:])]
            columns.append(pa.array(range(salt, salt + len(at)), pa.int64()))
            salt += len(at)
            yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids_crc32", "salt"])
        if units:
            forget()

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Least ``|a x - b|`` with ``x >= 0``, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    scale = 1e-6 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds or 4 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= scale:
            break
        active[j] = True
        while True:
            places = np.flatnonzero(active)
            own = a[:, places]
            fit = np.linalg.solve(own.T @ own + 1e-9 * np.eye(len(places)), own.T @ b)
            low = fit <= 0
            if not low.any():
                x[:] = 0
                x[places] = fit
                break
            step = float(np.min(x[places][low] / (x[places][low] - fit[low])))
            x[places] += step * (fit - x[places])
            gone = places[low & (x[places] <= 1e-9)]
            active[gone if len(gone) else places[low][:1]] = False
            x[~active] = 0
    return x


def patterns(there: list[int], bins: int) -> list[tuple[int, ...]]:
    """Patterns of at most three of the bins ``there``, largest first: each bin or pair with the largest further one that fits."""
    there = sorted(there)

    def widest(room: int, most: int) -> tuple[int, ...]:
        at = bisect_right(there, min(room, most))
        return (there[at - 1],) if at else ()

    found = {(i, *widest(bins - i, i)) for i in there}
    found |= {(i, j, *widest(bins - i - j, j)) for i in there for j in there if j <= i and i + j <= bins}
    return sorted(found)


#: ``(sequences, lengths)``: so many sequences of one make-up.
Runs = list[tuple[int, list[int]]]


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> Runs:
    """Best fit decreasing, a run of equal sequences at a time."""
    open_runs: dict[int, list[tuple[int, list[int]]]] = {}  # by room
    rooms: list[int] = []  # sorted

    def put(room: int, n: int, lengths: list[int]) -> None:
        if room not in open_runs:
            insort(rooms, room)
        open_runs.setdefault(room, []).append((n, lengths))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):  # no sequence has room: new ones take as many as they hold
                each = min(capacity // size, left)
                put(capacity - each * size, left // each, [size] * each)
                left %= each
                continue
            room = rooms[at]
            n, lengths = open_runs[room].pop()
            used = min(n, left)
            if used < n:
                open_runs[room].append((n - used, lengths))
            if not open_runs[room]:
                del open_runs[room], rooms[at]
            put(room - size, used, [*lengths, size])
            left -= used
    return [run for own in open_runs.values() for run in own]


def fitted(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN) -> Runs:
    """Runs by patterns: fitted, rounded down, filled; residual lengths by best fit decreasing."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    runs: Runs = []

    def longest(most: int) -> int:
        """The longest length that is left and not above ``most``, or 0."""
        found = np.flatnonzero(left[1 : most + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def fill(chosen: list[int], times: int) -> int:
        """Best fit closes the sequence; as many equal ones as the lengths allow, up to ``times``."""
        used: dict[int, int] = {}
        for x in chosen:
            used[x] = used.get(x, 0) + 1
            left[x] -= 1
        room = capacity - sum(chosen)
        while room and (x := longest(room)):
            chosen.append(x)
            used[x] = used.get(x, 0) + 1
            left[x] -= 1
            room -= x
        more = min([times - 1, *(int(left[x]) // n for x, n in used.items())])
        for x, n in used.items():
            left[x] -= n * more
        runs.append((more + 1, chosen))
        return more + 1

    bins = capacity // grain
    lengths = np.flatnonzero(left)
    target = np.zeros(bins)
    np.add.at(target, (lengths + grain - 1) // grain - 1, left[lengths])
    shapes = patterns((np.flatnonzero(target) + 1).tolist(), bins)
    a = np.zeros((bins + 1, len(shapes)))
    a[bins] = 0.5  # few sequences count beside the fit
    for j, shape in enumerate(shapes):
        for i in shape:
            a[i - 1, j] += 1
    goal = np.append(target, 0.5 * float(lengths @ left[lengths]) / capacity)
    unit = max(1.0, float(target.sum()))
    for j, n in enumerate(np.floor(nnls(a, goal / unit) * unit + 1e-6).astype(int).tolist()):
        shape = shapes[j]
        while n > 0:
            chosen: list[int] = []
            for i in shape[:-1]:
                lo, hi = (i - 1) * grain + 1, i * grain
                options = [x for x in range(hi, lo - 1, -1) if left[x] > chosen.count(x)]
                if not options:
                    break
                chosen.append(options[0])
            else:
                if not chosen:
                    x = longest(min(capacity, shape[0] * grain))
                    if not x:
                        break
                    chosen = [x]
                n -= fill(chosen, n)
                continue
            break
    rest = np.flatnonzero(left)
    return runs + best_fit_decreasing(dict(zip(rest.tolist(), left[rest].tolist())), capacity)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN) -> Runs:
    """Runs that use up ``histogram`` (pieces by length): by patterns, or by best fit decreasing where that takes fewer sequences."""
    full = [(histogram[capacity], [capacity])] if histogram.get(capacity) else []
    rest = {x: n for x, n in histogram.items() if n and x != capacity}
    if not rest:
        return full
    return full + min(fitted(rest, capacity, grain), best_fit_decreasing(rest, capacity), key=lambda runs: sum(n for n, _ in runs))


def slots(runs: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first, last, sequence, offset)``: pieces ``first..last`` of a length go to one slot of ``sequence`` onwards."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for n, lengths in runs:
        offset = 0
        for x in lengths:
            first = used.get(x, 0)
            out.append((x, first, first + n - 1, sequence, offset))
            used[x] = first + n
            offset += x
        sequence += n
    return out


def pack(found: DataFrame, *, id_col: str = "doc_id", capacity: int = CAPACITY, grain: int = GRAIN, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``sequence_id`` and ``offset`` in place of the ``salt`` of the pieces of ``found``, which must be stored."""
    spark = found.sparkSession
    columns = [c for c in found.columns if c not in ("sequence_id", "offset", "salt")]
    full = found.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    found = found.where(F.col("length") < capacity)
    histogram = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # fewer rows than capacity
    ranges = slots(plan(histogram, capacity, grain))
    table = spark.createDataFrame(ranges or [(0, 0, -1, 0, 0)], "length bigint, first bigint, last bigint, base bigint, offset bigint")
    #: the slots of a length as an array, so that one hash join by length finds them (their number is bounded as the plan is)
    by_length = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "last", "base", F.col("offset").alias("at")))).alias("__slots"))
    by_length = by_length.withColumn("__buckets", F.ceil(F.array_max(F.transform("__slots", lambda s: s["last"] + 1)) / bucket_rows))
    numbered = found.join(F.broadcast(by_length.select("length", "__buckets")), "length").withColumn("__bucket", F.pmod(F.hash(id_col, "piece", "ids_crc32", "salt"), F.greatest("__buckets", F.lit(1)))).drop("__buckets")
    counts = numbered.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__bucket").orderBy(id_col, "piece", "ids_crc32", "salt")
    ranked = numbered.withColumn("__rank", F.row_number().over(within) - 1).join(bases, ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__base")).drop("__base", "__bucket")
    hit = F.filter("__slots", lambda s: (s["first"] <= F.col("__rank")) & (F.col("__rank") <= s["last"]))[0]
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("__slot", hit)
    return placed.select(*columns, (F.col("__slot.base") + F.col("__rank") - F.col("__slot.first")).alias("sequence_id"), F.col("__slot.at").alias("offset")).unionByName(full)


def pack_documents(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, grain: int = GRAIN, units: int | None = None) -> DataFrame:
    """Pieces of every document with their place in the packed sequences; ``units`` as in ``pieces``."""
    return pack(keep(pieces(df, vocabulary, id_col=id_col, text=text, capacity=capacity, units=units), "pieces"), id_col=id_col, capacity=capacity, grain=grain)
