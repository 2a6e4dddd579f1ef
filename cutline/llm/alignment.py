"""Alignment of two tokenizers over whole texts: groups, links and how often ids are linked.

Tokenizer A is byte-level BPE, B a sentencepiece model. Both read a space and the
text. Their tokens are laid end to end on one line of bytes, documents of an Arrow
batch one after another; one ``bincount`` of A's ends and one of B's says where
either or both end, and prefix sums of these say which tokens cover a byte, which
group a token is in and, at the documents' bounds, how many of each a document has:

* a group lies between places where both end;
* a link is an A and a B token that share a byte; each stretch between neighbouring
  ends of either kind is one link.

Texts reach the line in windows of about ``WINDOW`` bytes that end where both end,
so a very long text needs no more memory than its ids and distinct links.

An id pair's count is the number of its links in all texts. Each row carries its
distinct pairs with their numbers, as stored; counts come from one aggregation of
these. The most frequent pairs, at most ``COMMON`` of them, return to the rows by
broadcast; a row's other pairs, each of them rare, by a join on the pair.

Words are tokenized once while a worker remembers them: white space starts a word
in A, and a piece of B never goes on after a space or beside a line feed (checked
when it is loaded; otherwise whole texts are tokenized).

Defined results: texts that are null, empty, or not restored byte for byte by both
(such as those with U+2581) have zeros and an empty digest; special strings are
plain text; equal rows are separate rows, which count each; an empty table gives no
rows; of the input only id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, ship
from .tokens import CACHE_UNITS, WHITE_SPACE, byte_letters, way_of_splitting

#: Bytes of text that are aligned at a time.
WINDOW = 1 << 20
#: Pairs that are broadcast: 17 bytes each.
COMMON = 1 << 20
#: Rows a batch that leaves a task.
ROWS = 200

_OTHER = WHITE_SPACE.replace(" ", "", 1).replace("\n", "")
#: White space and a word, up to a space or line feed after a word.
_UNITS = re.compile(f"[{WHITE_SPACE}]*+(?:[^{WHITE_SPACE}]++(?:[{_OTHER}][{WHITE_SPACE}]*+)?+)*+")
_SHAPE = ("n_a", "n_b", "n_groups", "n_links")


class Pair:
    """Both tokenizers, the bytes of their tokens, and the words met before."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        spec = json.loads(self.a.to_str())
        byte_of = {chr(c): b for b, c in byte_letters().items()}
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        bytes_a = [bytes(map(byte_of.get, names[i])) if i in names and all(c in byte_of for c in names[i]) else names.get(i, "").encode() for i in range(max(names) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = bytes_a, bytes_b
        self.length_a, self.length_b = (np.array([len(x) for x in found], np.int64) for found in (bytes_a, bytes_b))
        self.start = self.b.piece_to_id("▁")
        crossing = any(re.search("[^▁]▁", p) or ("\n" in p and len(p) > 1) for p in pieces)
        self.by_word = not crossing and way_of_splitting(spec) == "spaced" and self._bytes(self.b.encode("a  b\n"), bytes_b) == b" a  b\n"
        line_a, line_b = self.a.encode("\n", add_special_tokens=False).ids, self.b.encode("\n")[1:]
        self.by_word &= len(line_a) == len(line_b) == 1
        self.line_a, self.line_b = line_a[0], line_b[-1]
        self.words: dict[str, tuple[bytes, bytes] | None] = {}
        number = [str(i) for i in range(max(len(bytes_a), len(bytes_b)))]
        self.comma, self.bar, self.semicolon = (np.array([n + mark for n in number], object) for mark in ",|;")

    @staticmethod
    def _bytes(ids: list[int], own: list[bytes]) -> bytes:
        return b"".join([own[i] for i in ids])

    def learn(self, words: set[str]) -> None:
        """Tokenize words that aren't known, all of one kind in one call; None for those that aren't restored."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > CACHE_UNITS:
            self.words.clear()
            new = list(words)
        lines = [w for w in new if w[0] == " " and "\n" not in w and len(w) > 1] if self.by_word else []
        if lines and not self._learn_lines(lines):
            lines = []
        done = set(lines)
        for w in new:
            if w not in done:
                a, b = self.a.encode(w, add_special_tokens=False).ids, self._pieces(w)
                own = w.encode()
                same = self._bytes(a, self.bytes_a) == own and self._bytes(b, self.bytes_b) == own
                self.words[w] = (np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes()) if same else None

    def _pieces(self, word: str) -> list[int]:
        """B's ids of a word with its white space; B itself adds a space to what it reads."""
        if word == " ":
            return [self.start]  # B adds none to an empty text
        if word[0] == " ":
            return self.b.encode(word[1:])
        ids = self.b.encode(word)
        return ids[1:] if ids[:1] == [self.start] else [0]

    def _learn_lines(self, words: list[str]) -> bool:
        """Learn words, each with a space before it and none with a line feed, as lines of one text: a line feed is a token of its own in both. False if that text isn't restored."""
        text = "\n".join(words)
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        own = text.encode()
        if self._bytes(a, self.bytes_a) != own or self._bytes(b, self.bytes_b) != own:
            return False
        cut = []
        for ids, end in ((np.array(a, "<i4"), self.line_a), (np.array(b, "<i4"), self.line_b)):
            ends = np.flatnonzero(ids == end)
            if len(ends) != len(words) - 1:
                return False
            flat = ids.tobytes()
            cut.append([flat[x:y] for x, y in zip([0, *(4 * ends + 4).tolist()], [*(4 * ends).tolist(), len(flat)], strict=True)])
        self.words.update(zip(words, zip(*cut, strict=True), strict=True))
        return True

    def split(self, text: str) -> list[str]:
        """A space and the text as words with their white space."""
        text = " " + text
        return _UNITS.findall(text)[:-1] if self.by_word else [text]  # the last match is empty

    def encoded(self, words: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of A and B in windows that end where both end; nothing for texts that aren't restored."""
        try:
            found = [self.words[w] for w in words]
        except KeyError:  # forgotten meanwhile
            self.learn(set(words))
            found = [self.words[w] for w in words]
        if None in found:
            return
        step = WINDOW // 8
        for lo in range(0, len(found), step):
            part = found[lo : lo + step]
            yield b"".join([x[0] for x in part]), b"".join([x[1] for x in part])


class Line:
    """Texts' tokens on one line of bytes, with the rows they are of."""

    def __init__(self, pair: Pair):
        self.pair, self.size = pair, 0
        self.a, self.b, self.rows = [], [], []

    def add(self, row: int, a: bytes, b: bytes) -> None:
        self.a.append(a)
        self.b.append(b)
        self.rows.append(row)
        self.size += 2 * len(b)

    def align(self) -> Iterator[tuple[int, tuple[int, ...], str, np.ndarray, np.ndarray]]:
        """For each part: its row, ``_SHAPE``, its groups as text (a semicolon after each), its distinct pairs and their numbers."""
        own = self.pair
        a, b = np.frombuffer(b"".join(self.a), "<i4"), np.frombuffer(b"".join(self.b), "<i4")
        upto_a, upto_b = (np.cumsum([0, *(len(x) // 4 for x in found)]) for found in (self.a, self.b))
        ends_a, ends_b = np.cumsum(own.length_a[a]), np.cumsum(own.length_b[b])
        if not len(a):
            return
        total = int(ends_a[-1])
        at_a, at_b = np.bincount(ends_a, minlength=total + 1), np.bincount(ends_b, minlength=total + 1)
        both, either = at_a & at_b, at_a | at_b
        before_a, before_b, groups, links = (np.cumsum(x) for x in (at_a, at_b, both, either))
        bounds = np.concatenate([[0], ends_a])[upto_a]  # each part's first byte
        # a stretch between neighbouring ends is a link
        ends = np.flatnonzero(either)
        linked = a[before_a[ends - 1]].astype(np.int64) * len(own.bytes_b) + b[before_b[ends - 1]]
        part = np.repeat(np.arange(len(self.rows)), np.diff(links[bounds]))
        codes, numbers = np.unique(part * (len(own.bytes_a) * len(own.bytes_b)) + linked, return_counts=True)
        part_of, codes = np.divmod(codes, len(own.bytes_a) * len(own.bytes_b))
        cuts = np.searchsorted(part_of, np.arange(len(self.rows) + 1))
        # a group's A ids, then its B ids
        edges = np.concatenate([[0], np.flatnonzero(both)])
        texts = np.empty(len(a) + len(b), object)
        texts[np.arange(len(a)) + before_b[edges[groups[ends_a - 1]]]] = np.where(both[ends_a] > 0, own.bar[a], own.comma[a])
        texts[np.arange(len(b)) + before_a[edges[groups[ends_b - 1] + 1]]] = np.where(both[ends_b] > 0, own.semicolon[b], own.comma[b])
        texts = texts.tolist()
        of_groups, of_links = np.diff(groups[bounds]), np.diff(links[bounds])
        for k, row in enumerate(self.rows):
            lo, hi = int(upto_a[k] + upto_b[k]), int(upto_a[k + 1] + upto_b[k + 1])
            shape = int(upto_a[k + 1] - upto_a[k]), int(upto_b[k + 1] - upto_b[k]), int(of_groups[k]), int(of_links[k])
            yield row, shape, "".join(texts[lo:hi]), codes[cuts[k] : cuts[k + 1]], numbers[cuts[k] : cuts[k + 1]]


_LOADED: dict[tuple[str, str], Pair] = {}


def loaded(path_a: str, path_b: str) -> Pair:
    """Both tokenizers, loaded once in a worker."""
    if (path_a, path_b) not in _LOADED:
        _LOADED.clear()
        _LOADED[path_a, path_b] = Pair(path_a, path_b)
    return _LOADED[path_a, path_b]


def align_texts(pair: Pair, texts: list[str | None]) -> list[tuple[tuple[int, ...], str, np.ndarray, np.ndarray]]:
    """For each text: ``_SHAPE``, the digest of its groups, its distinct pairs (ascending) and their numbers."""
    shapes, digests = np.zeros((len(texts), len(_SHAPE)), np.int64), [None] * len(texts)
    pairs: list[list] = [[] for _ in texts]
    line = Line(pair)

    def flush() -> None:
        nonlocal line
        for row, shape, groups, codes, numbers in line.align():
            if digests[row] is None:
                digests[row] = hashlib.sha256(groups[:-1].encode())  # a semicolon stands between groups only
            else:
                digests[row].update(f";{groups[:-1]}".encode())
            shapes[row] += shape
            pairs[row].append((codes, numbers))
        line = Line(pair)

    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= WINDOW):
            size += len(texts[hi] or "")
            hi += 1
        split = [pair.split(t) if t else [] for t in texts[lo:hi]]
        pair.learn({w for words in split for w in words})
        for row, words in enumerate(split, lo):
            for a, b in pair.encoded(words) if words else ():
                line.add(row, a, b)
                if line.size >= WINDOW:
                    flush()
        lo = hi
    flush()
    out = []
    for shape, digest, found in zip(shapes.tolist(), digests, pairs, strict=True):
        if len(found) == 1:
            codes, numbers = found[0]
        else:
            every = np.concatenate([c for c, _ in found] or [np.zeros(0, np.int64)])
            codes, at = np.unique(every, return_inverse=True)
            numbers = np.bincount(at, np.concatenate([n for _, n in found] or [np.zeros(0)]), len(codes)).astype(np.int64)
        out.append((shape, digest.hexdigest() if digest else "", codes, numbers))
    return out


def _lists(found: list[np.ndarray], kind: str) -> pa.ListArray:
    bounds = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(found).astype(kind)))


def aligned(df: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, numbers`` of every row.

    ``pairs`` are A id x (size of B) + B id, ``numbers`` the links of each; ``row`` numbers the rows.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, row = loaded(path_a, path_b), TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                shapes, digests, pairs, numbers = zip(*align_texts(pair, part.column(1).to_pylist()), strict=True)
                counts = [pa.array(c, pa.int64()) for c in zip(*shapes, strict=True)]
                rows = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([rows, part.column(0), *counts, pa.array(digests), _lists(pairs, "i8"), _lists(numbers, "i8")], ["row", "id", *_SHAPE, "groups_sha256", "pairs", "numbers"])

    counts = ", ".join(f"{c} bigint" for c in _SHAPE)
    return df.select(id_col, text).mapInArrow(run, f"row bigint, id {dict(df.dtypes)[id_col]}, {counts}, groups_sha256 string, pairs array<bigint>, numbers array<bigint>")


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """``pair, n, best`` of every id pair in stored ``aligned`` rows; ``best``: no pair of its B id has more links."""
    counts = keep(rows.select(F.inline(F.arrays_zip("pairs", "numbers"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("numbers").alias("n")), "pair-counts")
    most = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))  # a row for each of B's ids at most
    return counts.join(F.broadcast(most), F.col("pair") % size_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _least_common(counts: DataFrame, common: int) -> int:
    """The least power of two such that at most ``common`` pairs have as many links."""
    sizes = {r["bits"]: r["count"] for r in counts.groupBy(F.length(F.bin("n")).alias("bits")).count().collect()}  # 63 rows at most
    held, bits = 0, 64
    while bits > 1 and held + sizes.get(bits - 1, 0) <= common:
        bits -= 1
        held += sizes.get(bits, 0)
    return 1 << (bits - 1)


def align_tokenizers(df: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text: str = "text", common: int = COMMON) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``count_sum`` sums the links' counts, ``n_best`` counts the links whose count is the highest of their B id.
    """
    import sentencepiece

    rows = keep(aligned(df, path_a, path_b, id_col=id_col, text=text), "aligned")
    counts = keep(pair_counts(rows, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()), "pairs")
    least = _least_common(counts, common)
    top = counts.where(F.col("n") >= least).orderBy("pair").toArrow()
    shared = df.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for batch in batches:
            pairs, numbers = batch.column("pairs"), batch.column("numbers").flatten().to_numpy()
            bounds = np.cumsum([0, *pairs.value_lengths().to_numpy()])
            pairs = pairs.flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            weight = np.where(known, numbers, 0)
            sums, bests = np.zeros(len(pairs) + 1, np.int64), np.zeros(len(pairs) + 1, np.int64)
            if len(keys):
                sums[1:], bests[1:] = np.cumsum(weight * counts[at]), np.cumsum(weight * best[at])
            missing = np.concatenate([[0], np.cumsum(~known)])[bounds]
            rest = [pa.ListArray.from_arrays(pa.array(missing.astype(np.int32)), pa.array(x[~known])) for x in (pairs, numbers)]
            own = [batch.column(c) for c in ("row", "id", *_SHAPE, "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(bests[bounds])), pa.array(np.diff(sums[bounds])), *rest], ["row", "id", *_SHAPE, "groups_sha256", "n_best", "count_sum", "pairs", "numbers"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in ("row", "id", *_SHAPE, "groups_sha256")] + ["n_best bigint", "count_sum bigint", "pairs array<bigint>", "numbers array<bigint>"])
    found = rows.mapInArrow(run, schema)
    out = [F.col("id").alias(id_col), *_SHAPE, "n_best", "count_sum", "groups_sha256"]
    if least == 1:  # every pair was broadcast
        return found.select(*out)
    found = keep(found, "aligned-common")
    rare = found.select("row", F.inline(F.arrays_zip("pairs", "numbers"))).join(counts.where(F.col("n") < least).withColumnRenamed("pair", "pairs"), "pairs")
    sums = rare.groupBy("row").agg(F.sum(F.col("numbers") * F.col("n")).alias("sum_rest"), F.sum(F.when(F.col("best"), F.col("numbers")).otherwise(0)).alias("best_rest"))
    whole = found.join(sums, "row", "left")
    return whole.withColumns({"n_best": F.col("n_best") + F.coalesce("best_rest", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("sum_rest", F.lit(0))}).select(*out)
