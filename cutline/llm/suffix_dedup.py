"""Suffix-array dedup: column-wise construction of a collection's suffix order.

Removes every byte covered by a ``length``-byte string that also starts somewhere
else in the corpus, the same document included; every occurrence is removed.

*Pieces.* A document is too long to be a row of a column-wise construction, so its
windows (the ``length``-byte strings) are dealt out first, by winnowing: the
window's anchor is its ``gram``-byte substring of least hash (the leftmost of
equals). Equal windows have equal anchors at equal places, so no pair is parted.
Windows that follow one another with one anchor form a piece, so every window
belongs to exactly one piece. Only pieces whose anchor hash occurs twice go on.

*Collection.* Pieces with equal bytes are one member that counts its copies; if
there are several, all its windows are repeated. Members of an anchor that has
more than one enter a collection, read as strings of ``SYMBOL``-byte symbols (each
phase of the windows' starts is a string of its own). ``repeated_suffixes`` builds
the collection's Burrows-Wheeler transform and common-prefix array column by
column: each round inserts one symbol for each string, in front of the suffix that
the last round inserted; both arrays live in files that a round reads and rewrites
from front to back. A window is repeated where the common prefix with a neighbour
in the order reaches ``length`` bytes.

*Size.* Shuffles move hashes and places; of texts, only those with a member of a
collection or a removed span are shuffled. An anchor with more than ``CROWD``
members is split by the bytes that all windows of a range of starts share, which
equal windows share too. Ranges that still have more than ``CROWD`` members are
split to single windows, which are counted by digest with partial sums in each
task, so no collection holds more members of an anchor or range than that. The two
ways give the same windows; ``CROWD`` only says which of them looks. Rows of hot
anchors and pieces stay in place and meet a broadcast of a bounded number of keys.

Defined results: texts are UTF-8; a null text is empty and stays null in
``clean_text``; shorter texts than ``length`` lose nothing; equal rows are repeats
of each other; touching removed runs are one span; an empty table gives an empty
table; columns that clash with an added name are replaced.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, keep, ship, text_key

LENGTH = 400
GRAM = 100
#: Bytes of a symbol of the construction; it must divide the length.
SYMBOL = 16
#: Bytes of members that are gathered into one collection; anchors are not parted.
COLLECTION_BYTES = 128_000
#: Members of one anchor beyond which its windows are split by shared bytes, and starts in each range.
CROWD, RANGE = 4_000, 32

_BASE = 0x9E3779B97F4A7C15
_TABLES: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _TABLES[k : k + 1] = [np.multiply.accumulate(table)]
    return _TABLES[0], _TABLES[1]


def gram_hashes(raw: bytes, gram: int) -> np.ndarray:
    """A hash of each ``gram``-byte substring."""
    n = len(raw)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    found = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(32)
    return found


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def winnow(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """``(hash, first, windows, place)``: ``windows`` starts from ``first`` have their anchor ``place`` bytes after ``first``."""
    if len(raw) < length:
        return []
    width = length - gram + 1
    hashes = gram_hashes(raw, gram)
    least = window_minima(hashes, width)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    out = []
    for a, b in zip(starts.tolist(), np.r_[starts[1:], len(least)].tolist()):
        value = least[a]
        first = a
        for place in (np.flatnonzero(hashes[a : b + width - 1] == value) + a).tolist():
            last = min(b - 1, place)
            if last >= first:
                out.append((int(value.view(np.int64)), first, last - first + 1, place - first))
                first = last + 1
            if first >= b:
                break
    return out


class _Column:
    """An array in a file that each round reads from front to back and writes anew."""

    def __init__(self, folder: str, name: str, kind: type):
        self.file, self.kind = open(os.path.join(folder, name), "w+b", buffering=0), np.dtype(kind)  # noqa: SIM115

    def write(self, values: np.ndarray) -> None:
        """Values never get fewer, so the file is written over in place."""
        self.file.seek(0)
        self.file.write(memoryview(np.ascontiguousarray(values, self.kind)).cast("B"))

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), self.kind)

    def close(self) -> None:
        self.file.close()


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray, block: int = 128) -> np.ndarray:
    """Least of ``values[low:high]`` for many ranges, none empty; long ones by the minima of blocks."""
    guarded = np.append(values, values.dtype.type(0))

    def direct(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(v, np.column_stack([a, b]).ravel())[::2] if len(a) else v[:0]

    first, last = -(-low // block), high // block
    far = first + 1 < last
    out = np.empty(len(low), values.dtype)
    out[~far] = direct(guarded, low[~far], high[~far])
    if far.any():
        a, b, first, last = low[far], high[far], first[far], last[far]
        blocks = np.append(np.minimum.reduceat(values, np.arange(0, len(values), block)), values.dtype.type(0))
        found = direct(blocks, first, last)
        found = np.minimum(found, direct(guarded, a, np.maximum(first * block, a + 1)))
        out[far] = np.minimum(found, direct(guarded, np.minimum(last * block, b - 1), b))
    return out


def repeated_suffixes(strings: list[np.ndarray], least: int, folder: str) -> list[np.ndarray]:
    """For each string of symbols (positive integers): the starts of suffixes that share ``least`` symbols with another.

    Round ``j`` inserts the suffix of ``j`` symbols of every string that has one.
    Its place follows from the last round's: suffixes with one first symbol stand
    in the order of what follows the symbol. Its common prefix with a neighbour of
    the same first symbol is one more than the least value between the two in the
    last round's array. Ends sort before symbols, in the order of the strings, and
    never match.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    flat = np.concatenate([*strings, np.zeros(1, np.int64)]).astype(np.int64)
    ends = np.cumsum(sizes)
    symbols, prefixes = _Column(folder, "symbols", np.uint16 if flat.max(initial=0) < 2**16 else np.uint32), _Column(folder, "prefixes", np.uint16)

    def before(which: np.ndarray, taken: int) -> np.ndarray:
        """The symbol in front of the suffix of ``taken`` symbols; 0 in front of the whole string."""
        return np.where(sizes[which] > taken, flat[np.maximum(ends[which] - taken - 1, 0)], 0)

    which = np.arange(m)
    rows = np.arange(m)
    symbols.write(before(which, 0))
    prefixes.write(np.zeros(m))
    for taken in range(1, int(sizes.max(initial=0)) + 1):
        bwt, lcp = symbols.read(), prefixes.read()
        going = sizes[which] >= taken
        which, rows = which[going], rows[going]
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        at, own = rank[rows], bwt[rows]
        prior, later = order[np.maximum(at - 1, 0)], order[np.minimum(at + 1, len(bwt) - 1)]
        has_prior = (at > 0) & (bwt[prior] == own)
        has_later = (at + 1 < len(bwt)) & (bwt[later] == own)
        low, high = np.zeros(len(rows), lcp.dtype), np.zeros(len(rows), lcp.dtype)
        low[has_prior] = _range_minima(lcp, prior[has_prior] + 1, rows[has_prior] + 1)
        high[has_later] = _range_minima(lcp, rows[has_later] + 1, later[has_later] + 1)
        places = at - int(np.count_nonzero(bwt == 0)) + m
        room = np.ones(len(bwt) + len(rows), bool)
        room[places] = False
        new_bwt, new_lcp = np.empty(len(room), bwt.dtype), np.empty(len(room), lcp.dtype)
        new_bwt[room], new_lcp[room] = bwt, lcp
        new_bwt[places] = before(which, taken)
        inside = places + 1 < len(room)
        new_lcp[places[inside] + 1] = np.where(has_later, high + 1, 0)[inside]
        new_lcp[places] = np.where(has_prior, low + 1, 0)
        symbols.write(new_bwt)
        prefixes.write(new_lcp)
        back = np.argsort(places)
        which, rows = which[back], places[back]
    # walk from the ends through the finished order, one symbol a step
    bwt, lcp = symbols.read(), np.append(prefixes.read(), np.uint16(0))
    symbols.close()
    prefixes.close()
    step = np.empty(len(bwt), np.int64)
    step[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    step += m - int(np.count_nonzero(bwt == 0))
    repeated = np.maximum(lcp[:-1], lcp[1:]) >= least
    owners, starts = [], []
    which, rows = np.arange(m), np.arange(m)
    for taken in range(1, int(sizes.max(initial=0)) + 1):
        going = sizes[which] >= taken
        which, rows = which[going], step[rows[going]]
        hit = which[repeated[rows]]
        owners.append(hit)
        starts.append(sizes[hit] - taken)
    owner, start = np.concatenate([*owners, which[:0]]), np.concatenate([*starts, sizes[:0]])
    back = np.lexsort((start, owner))
    return np.split(start[back], np.searchsorted(owner[back], np.arange(1, m)))


def repeated_windows(members: list[tuple[bytes, int]], length: int = LENGTH, symbol: int = SYMBOL) -> list[np.ndarray]:
    """For each member (bytes, place of its anchor): starts of its windows that another window equals."""
    strings, origin = [], []
    for i, (raw, place) in enumerate(members):
        for phase in range(symbol):
            first = (place - phase) % symbol
            n = (len(raw) - first) // symbol
            if n * symbol >= length:
                strings.append(np.frombuffer(raw, np.dtype(f"V{symbol}"), n, first))
                origin.append((i, first))
    if not strings:
        return [np.zeros(0, np.int64) for _ in members]
    words = np.concatenate(strings)
    padded = np.zeros((len(words), 8 * -(-symbol // 8)), np.uint8)
    padded[:, :symbol] = words.view(np.uint8).reshape(-1, symbol)
    wide = padded.view(np.uint64)
    order = np.lexsort(wide.T)
    codes = np.empty(len(wide), np.int64)
    codes[order] = np.cumsum(np.r_[True, (wide[order[1:]] != wide[order[:-1]]).any(axis=1)])
    coded = np.split(codes, np.cumsum([len(s) for s in strings])[:-1])
    with tempfile.TemporaryDirectory() as folder:
        found = repeated_suffixes(coded, length // symbol, folder)
    out: list[list[np.ndarray]] = [[] for _ in members]
    for (i, first), starts in zip(origin, found):
        out[i].append(starts * symbol + first)
    return [np.sort(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in out]


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive starts as (first, last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist()))


PIECE = "k1 bigint, k2 bigint, anchor bigint, digest bigint, first bigint, windows int, place int"


def _pieces(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = []
                for k1, k2, text in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns)):
                    raw = text.encode("utf-8", "surrogatepass")
                    for anchor, first, n, place in winnow(raw, length, gram):
                        digest = xxhash.xxh3_64_intdigest(raw[first : first + n - 1 + length], place)
                        rows.append((k1, k2, anchor, digest - 2**63, first, n, place))
                columns = list(zip(*rows)) if rows else [()] * 7
                kinds = [pa.int64()] * 5 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["k1", "k2", "anchor", "digest", "first", "windows", "place"])

    return docs.where(F.octet_length("t") >= length).select("k1", "k2", "t").mapInArrow(run, PIECE)


MEMBER = "part bigint, anchor bigint, digest bigint, shift int, place int, raw binary"


def _members(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted pieces; those of crowded anchors in ranges of starts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            rows = []
            for k1, k2, text, wanted in zip(batch["k1"], batch["k2"], batch["t"], batch["wanted"]):
                if (k1, k2) == last:
                    continue  # another copy of the text
                last = (k1, k2)
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    anchor, digest, first, n, place = w["anchor"], w["digest"], w["first"], w["windows"], w["place"]
                    if not w["crowded"]:
                        rows.append((anchor, anchor, digest, 0, place, raw[first : first + n - 1 + length]))
                        continue
                    for part in range((place - n + 1) // RANGE, place // RANGE + 1):
                        # starts that stand RANGE * part to RANGE * (part + 1) - 1 bytes before the anchor
                        a, b = max(0, place - RANGE * (part + 1) + 1), min(n - 1, place - RANGE * part)
                        core = raw[first + place - RANGE * part : first + place - RANGE * (part + 1) + 1 + length]
                        key = xxhash.xxh3_64_intdigest(core, part + 1) - 2**63
                        rows.append((key, anchor, digest, a, place - a, raw[first + a : first + b + length]))
                if len(rows) >= 2_000:
                    yield pd.DataFrame(rows, columns=["part", "anchor", "digest", "shift", "place", "raw"])
                    rows = []
            yield pd.DataFrame(rows, columns=["part", "anchor", "digest", "shift", "place", "raw"])

    return texts.select("k1", "k2", "t", "wanted").mapInPandas(run, MEMBER)


def _collections(members: DataFrame, length: int, symbol: int) -> DataFrame:
    """``anchor, digest, low, high``: repeated starts of members, relative to the piece."""
    names = ["part", "anchor", "digest", "shift", "place", "raw"]

    def solve(rows: list[tuple]) -> pd.DataFrame:
        found = repeated_windows([(r[5], r[4]) for r in rows], length, symbol)
        out = [(r[1], r[2], a + r[3], b + r[3]) for r, starts in zip(rows, found) for a, b in _ranges(starts)]
        return pd.DataFrame(out, columns=["anchor", "digest", "low", "high"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        size, seen, current = 0, set(), None
        for batch in batches:
            for row in zip(*(batch[n] for n in names)):
                if row[0] != current:
                    if size >= COLLECTION_BYTES:
                        yield solve(rows)
                        rows, size = [], 0
                    current, seen = row[0], set()
                if row[1:4] in seen:
                    continue
                seen.add(row[1:4])
                rows.append(row)
                size += len(row[5])
        if rows:
            yield solve(rows)

    return members.repartition("part").sortWithinPartitions("part").mapInPandas(run, "anchor bigint, digest bigint, low bigint, high bigint")


def _crowded(ranged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of ranges, those of bounded ranges and those of crowded ones."""
    parts = keep(ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "parts")
    return tuple(hot_join(ranged, parts.where(of), ["part"]).drop("n") for of in (F.col("n") <= CROWD, F.col("n") > CROWD))


def _counted(members: DataFrame, length: int) -> DataFrame:
    """``anchor, digest, low, high`` as of ``_collections``, by counts of single windows; members are distinct."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for anchor, digest, shift, raw in zip(batch["anchor"], batch["digest"], batch["shift"], batch["raw"]):
                for start in range(len(raw) - length + 1):
                    both = xxhash.xxh3_128_intdigest(raw[start : start + length])
                    rows.append(((both >> 64) - 2**63, (both & 2**64 - 1) - 2**63, anchor, digest, shift + start))
            yield pd.DataFrame(rows, columns=["h1", "h2", "anchor", "digest", "low"])

    windows = members.select("anchor", "digest", "shift", "raw").mapInPandas(run, "h1 bigint, h2 bigint, anchor bigint, digest bigint, low bigint")
    windows = keep(windows, "windows")
    twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    return windows.join(twice, ["h1", "h2"], "left_semi").select("anchor", "digest", "low", F.col("low").alias("high"))


def repeated_spans(docs: DataFrame, text: str = "text", *, length: int = LENGTH, gram: int = GRAM, symbol: int = SYMBOL) -> DataFrame:
    """``k1, k2, spans`` for each text with repeated windows: (start, end) in bytes, neither sorted nor merged."""
    if length % symbol or not 0 < gram < length:
        raise ValueError("symbol must divide length, and gram must be shorter")
    ship(docs.sparkSession)
    keyed = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).select(*text_key(F.col("t")), "t")
    pieces = keep(_pieces(keyed, length, gram), "pieces")
    twice = keep(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
    some = keep(hot_join(pieces, twice, ["anchor"]).drop("n"), "repeated-anchors")
    distinct = some.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "first", "windows", "place")).alias("at"))
    distinct = keep(distinct, "members")
    crowds = keep(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "crowds")
    wanted = hot_join(distinct, crowds, ["anchor"], "size").select("at.k1", "at.k2", F.struct("anchor", "digest", "at.first", "at.windows", "at.place", (F.col("size") > CROWD).alias("crowded")).alias("w"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))
    texts = keyed.join(wanted, ["k1", "k2"])
    crowded = lambda of: texts.withColumn("wanted", F.filter("wanted", lambda w: w["crowded"] == of)).where(F.size("wanted") > 0)
    found = _collections(_members(crowded(False), length), length, symbol)
    if crowds.where(F.col("size") > CROWD).limit(1).count():
        ranged = keep(_members(crowded(True), length).dropDuplicates(["part", "anchor", "digest", "shift"]), "ranges")
        bounded, full = _crowded(ranged)
        found = found.unionByName(_collections(bounded, length, symbol)).unionByName(_counted(full, length))
    run = F.struct(F.lit(0).cast("long").alias("low"), (F.col("at.windows") - 1).cast("long").alias("high"))
    whole = distinct.where("n > 1").select("anchor", "digest", "n", F.array(run).alias("runs"))
    alone = distinct.where("n = 1").select("anchor", "digest", "n")
    inside = found.join(alone, ["anchor", "digest"]).groupBy("anchor", "digest").agg(F.first("n").alias("n"), F.collect_list(F.struct("low", "high")).alias("runs"))
    ranges = hot_join(some, keep(whole.unionByName(inside), "runs"), ["anchor", "digest"]).select("k1", "k2", "first", F.explode("runs").alias("r"))
    spans = ranges.select("k1", "k2", F.struct((F.col("first") + F.col("r.low")).alias("a"), (F.col("first") + F.col("r.high") + length).alias("b")).alias("s"))
    return keep(spans.groupBy("k1", "k2").agg(F.collect_set("s").alias("spans")), "spans")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    return merged


ADDED = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def remove_repeats(docs: DataFrame, text: str = "text", *, length: int = LENGTH, gram: int = GRAM, symbol: int = SYMBOL, with_text: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``clean_text``.

    ``clean_text`` is what is left, decoded; parts of characters that a span cut
    in two are left out there (``kept_sha256`` covers the very bytes).
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["clean_text"] * with_text
    rest = [c for c in docs.columns if c not in names]
    base = docs.select(*rest)
    spans = repeated_spans(base, text, length=length, gram=gram, symbol=symbol).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("spans").alias("__spans"))
    keyed = base.select("*", *[k.alias(n) for k, n in zip(text_key(F.col(text)), ("__a", "__b"))])
    joined = keyed.join(spans, (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2")), "left").select(*rest, "__spans")
    at, n = rest.index(text), len(rest)
    out = base.columns if with_text else [c for c in rest if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, spans in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist()):
                raw = (value or "").encode("utf-8", "surrogatepass")
                merged = merge_spans([(s["a"], s["b"]) for s in spans or []])
                left, done = [], 0
                for a, b in merged:
                    left.append(raw[done:a])
                    done = b
                kept = b"".join([*left, raw[done:]])
                row = (len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest())
                rows.append((*row, None if value is None else value if not merged else kept.decode("utf-8", "ignore")) if with_text else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: len(names)]
            more = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(rest.index(c)) for c in out), *more], [*out, *names])

    kinds = dict(base.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in out] + [ADDED] + ["clean_text string"] * with_text)
    return joined.mapInArrow(run, schema)
