"""Benchmark decontamination by a generalised suffix automaton of the test items.

Test items are normalised to words and read into one generalised suffix
automaton. Documents stream their words through it; the automaton gives, word by
word, the longest match that ends there, and its suffix links give the items
whose windows end there. A window is ``length`` consecutive words of an item, or
the whole item if it has fewer words. Document words inside any occurrence of a
window are *hit*.

Items are taken in blocks of at most ``BLOCK_BYTES`` bytes of text (a longer item is
a block of its own), each sent to the executors by itself. There is one pass over the
documents and no shuffle, whatever the number of blocks: a task gathers texts, builds
one block's automaton after another, streams the gathered texts through it, and joins
what the blocks found. With one block, the usual case, a worker builds its automaton
once.

Defined results: a null text, or one without words, has no words and no hits; a
null item, or one without words, never occurs; equal items are all found; an item
id with several rows counts once, whichever of its rows occur; equal rows get equal
results; columns that clash with an added name are replaced; an empty benchmark leaves every document clean; an empty
document table gives an empty table. Of both inputs only id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Text of the items that one automaton holds; a worker needs about 250 times as much memory while it streams.
BLOCK_BYTES = 1_000_000
#: Text that a task gathers for each round of the blocks.
GATHERED_BYTES = 32_000_000

#: Bytes that are not part of a word become spaces: all ASCII but digits and letters; A-Z are lowered.
_TO_WORDS = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class ItemAutomaton:
    """Generalised suffix automaton over the words of many items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], length: int):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.length = length
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: for each state that holds windows: the items in which they occur, with the window's length
        self.windows: dict[int, list[tuple[int, tuple]]] = {}
        found: dict[tuple[int, int], set] = {}
        for item, codes in coded:
            size = min(length, len(codes))
            state, matched = 0, 0
            for end, c in enumerate(codes):
                state, matched = self.step(state, matched, c)
                if end + 1 >= size > 0:
                    holder = state
                    while self.len[self.link[holder]] >= size:
                        holder = self.link[holder]
                    found.setdefault((holder, size), set()).add(item)
        for (state, size), of in found.items():
            self.windows.setdefault(state, []).append((size, tuple(sorted(of, key=str))))
        #: for each state: itself and its suffixes that hold windows, longest window first
        self.ends: list[list[tuple[int, tuple]]] = [[] for _ in self.link]
        for state in sorted(range(len(self.link)), key=self.len.__getitem__):
            up = self.ends[self.link[state]] if state else []
            own = sorted(self.windows.get(state, ()), reverse=True, key=lambda x: x[0])
            self.ends[state] = own + up if own else up
        self.least = min((size for state in self.windows.values() for size, _ in state), default=0)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        me = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = me
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[me] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return me

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        nxt = self.next
        while state and c not in nxt[state]:
            state = self.link[state]
            matched = self.len[state]
        to = nxt[state].get(c)
        return (0, 0) if to is None else (to, matched + 1)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal runs of hit words as (start, end), and the items found."""
        spans: list[list[int]] = []
        items: set = set()
        if not self.least:
            return [], items
        known = bytes(map(self.vocabulary.__contains__, words))
        for run in re.finditer(b"\x01{%d,}" % self.least, known):
            state = matched = 0
            for end, c in enumerate(map(self.vocabulary.get, words[run.start() : run.end()]), run.start() + 1):
                state, matched = self.step(state, matched, c)
                if matched < self.least or not self.ends[state]:
                    continue
                longest = 0
                for size, of in self.ends[state]:
                    if size <= matched:
                        longest = max(longest, size)
                        items.update(of)
                if longest:
                    start = end - longest
                    while spans and start <= spans[-1][1]:
                        start = min(start, spans.pop()[0])
                    spans.append([start, end])
        return [(a, b) for a, b in spans], items


@lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[object, str], ...], length: int) -> ItemAutomaton:
    return ItemAutomaton([(i, words_of(t)) for i, t in items], length)


def item_blocks(benchmark: DataFrame, item_col: str, text: str, most: int) -> Iterator[tuple]:
    """The items, a block at a time; the driver holds one block."""
    block: list[tuple[object, str]] = []
    size = 0
    for row in benchmark.select(item_col, text).where(F.col(text).isNotNull()).toLocalIterator():
        more = len(row[1].encode("utf-8", "surrogatepass"))
        if block and size + more > most:
            yield tuple(block)
            block, size = [], 0
        block.append((row[0], row[1]))
        size += more
    if block:
        yield tuple(block)


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of ``spans`` and what stands between them."""
    if not spans or text is None:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    mapped = raw.translate(_TO_WORDS)
    ends: list[tuple[int, int]] = []
    at = 0
    for word in mapped.split():
        at = mapped.index(word, at)
        ends.append((at, at + len(word)))
        at += len(word)
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : ends[a][0]])
        done = ends[b - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def _items_digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items)).encode()).hexdigest()


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_col: str = "item_id", item_text: str = "text", length: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with the verdict of each row.

    Adds ``n_words, n_hit, n_items`` (long), ``items_sha256`` (string),
    ``contaminated`` (boolean: ``n_hit > 0 and share * n_hit >= n_words``) and
    ``clean_text`` (the text without its hit words).
    """
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text"]
    rest = [c for c in docs.columns if c not in added]
    spark, at = docs.sparkSession, rest.index(text)
    ship(spark)
    sent = [spark.sparkContext.broadcast(block) for block in item_blocks(benchmark, item_col, item_text, block_bytes)]

    def verdicts(gathered: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [batch.column(at).to_pylist() for batch in gathered]
        found = [[([], set()) for _ in own] for own in texts]
        words = [[words_of(x) for x in own] for own in texts]
        for block in sent:
            automaton = _automaton(block.value, length)
            for own, places in zip(words, found):
                for ws, (spans, items) in zip(own, places):
                    more, those = automaton.scan(ws)
                    spans += more
                    items |= those
        for batch, own, ws, places in zip(gathered, texts, words, found):
            yield _append(batch, [_verdict(x, w, merged(spans) if len(sent) > 1 else spans, items, share) for x, w, (spans, items) in zip(own, ws, places)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                gathered.append(part)
                size += part.column(at).get_total_buffer_size() if len(sent) > 1 else GATHERED_BYTES
                if size >= GATHERED_BYTES:
                    yield from verdicts(gathered)
                    gathered, size = [], 0
        if gathered:
            yield from verdicts(gathered)

    return docs.select(*rest).mapInArrow(run, _schema(docs.select(*rest), VERDICT))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping and touching ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([f"`{n}` {k}" for n, k in df.dtypes] + [more])


VERDICT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, clean_text string"


def _verdict(value: str | None, words: list[bytes], spans: list, items, share: int) -> tuple:
    hit = sum(b - a for a, b in spans)
    return len(words), hit, len(items), _items_digest(items), bool(hit and share * hit >= len(words)), cut_spans(value, spans)


def _append(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text"]
    more = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])
