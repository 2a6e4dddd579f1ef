"""Exact token counts of every prefix of a text, by dynamic programming over byte-level BPE.

``counts[i]`` is the number of tokens that the library gives for the first ``i``
characters. A token ``t`` ends the encoding of a prefix just if it is a suffix of
it and the pair of ``t`` with the token that ends the prefix before ``t`` is one
that BPE keeps as it is (encoding the pair's bytes gives the pair). Exactly one
token does, so a prefix's count is one more than that of a shorter prefix, and
one pass over a text gives the counts of all its prefixes. Text is split before
the merges, so the pass runs inside these pieces. A prefix's end changes the
splitting in two places, which ``_unit`` sees to: a run of white space is one
piece until a word follows, and ``'re`` is two pieces until its last letter.

Counts go up and down from one character to the next (a word's end may merge what
its beginning could not), always by less than the longest token, so the stored form
is a signed byte a character: ``prefix_table``. Budget and truncation questions
(``within_budget``, ``tokens_before``) are answered from it without encoding
again; ``count_tokens`` answers for a limit in one pass, without storing.

Defined results: a null or empty text has no tokens; special strings inside texts
are their special ids (one token), as the library's plain call has it, and a
special string not yet complete is plain text; equal rows have equal results; an
empty table gives no rows; of the input only id and text are read. Vocabulary
files other than byte-level BPE with the library's own splitting raise
``ValueError``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .tokens import LATIN, SPLIT_SPACED, WHITE_SPACE, _Cache, byte_letters, way_of_splitting

LIMIT = 1_024
#: Longer units (white space with the word after it) are not remembered.
LONG = 200
#: Texts a batch that leaves a task.
ROWS = 500

_UNITS = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_SPACES = re.compile(f"[{WHITE_SPACE}]*")
#: Contractions of three characters, which the library splits off as one piece.
_LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
_LETTERS = byte_letters()
_SPACE = chr(_LETTERS[32])
#: Stands for no token before a text's first.
_NONE = (1 << 16) - 1


class PrefixCounter:
    """Counts of all prefixes under one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        added = spec["added_tokens"]
        plain = not any(t[x] for t in added for x in ("single_word", "lstrip", "rstrip", "normalized"))
        if way_of_splitting(spec) != "spaced" or not plain:
            raise ValueError(f"{path} is not byte-level BPE with the library's own splitting")
        vocabulary = spec["model"]["vocab"]
        if max(map(len, vocabulary)) > 128 or max(vocabulary.values()) >= _NONE:
            raise ValueError(f"{path} has over 65,535 tokens, or one of over 128 bytes, whose steps a signed byte may not hold")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) or r"(?!)")
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = {i: t for t, i in vocabulary.items() if i not in {t["id"] for t in added}} | {_NONE: ""}
        self.tokens = ahocorasick.Automaton()
        for i, t in self.letters.items():
            if t:
                self.tokens.add_word(t, (i, len(t)))
        self.tokens.make_automaton()
        self.pairs = _Cache(self._pair)
        self.pieces = _Cache(self._piece)
        self.units = _Cache(self._unit)

    def _pair(self, pair: int) -> bool:
        """Does BPE leave a token (or none) and the next one as they are?"""
        before, token = divmod(pair, _NONE + 1)
        return [t.id for t in self.model.tokenize(self.letters[before] + self.letters[token])] == [x for x in (before, token) if x != _NONE]

    def _counts(self, letters: str) -> list[int]:
        """Counts of the prefixes, none included, of a piece that is not split, by bytes."""
        counts, last, kept = [0] * (len(letters) + 1), [_NONE] * (len(letters) + 1), self.pairs
        for end, (token, length) in self.tokens.iter(letters):  # in the order of their ends, longest first
            end += 1
            before = end - length
            if not counts[end] and (counts[before] or not before) and kept[last[before] * (_NONE + 1) + token]:
                counts[end], last[end] = counts[before] + 1, token
        return counts

    def _piece(self, text: str) -> bytes:
        """Steps of a piece that is not split, at its characters."""
        if text.isascii() and text.isprintable():  # every byte but the space stands for itself
            counts = self._counts(text.replace(" ", _SPACE))
        else:
            counts = self._counts(text.encode().decode("latin-1").translate(_LETTERS))
        if text in _LONG_CONTRACTIONS:
            counts[2] = 2
        if len(counts) - 1 != len(text):
            counts = [counts[e] for e in accumulate((len(c.encode()) for c in text), initial=0)]
        return bytes([b - a & 255 for a, b in pairwise(counts)])

    def _unit(self, unit: str) -> bytes:
        """Steps at each character of white space with the word that follows it."""
        known = lambda text: self.pieces[text] if len(text) <= LONG else self._piece(text)
        if unit.isascii() and unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()):
            return known(unit)
        spaces = _SPACES.match(unit).end()
        if spaces < 2 and LATIN.fullmatch(unit):
            return b"".join(map(known, SPLIT_SPACED.findall(unit)))
        if spaces == len(unit):
            return known(unit)
        pieces = [known(unit[a:b]) for _, (a, b) in self.split(unit)]
        if spaces < 2:
            return b"".join(pieces)
        # white space is one piece until a word follows
        counts = np.cumsum(np.frombuffer(b"".join(pieces), np.int8), dtype=np.int64)
        counts[:spaces] = np.cumsum(np.frombuffer(known(unit[:spaces]), np.int8), dtype=np.int64)
        return np.diff(counts, prepend=0).astype(np.int8).tobytes()

    def _plain(self, text: str) -> bytes:
        found = self.units
        return b"".join([found[u] if len(u) <= LONG else self._unit(u) for u in _UNITS.findall(text)])

    def steps(self, text: str | None) -> bytes:
        """A signed byte a character: by how much the count changes there."""
        if not text:
            return b""
        at, out = 0, []
        for special in self.special.finditer(text):
            begin, end = special.span()
            steps = self._plain(text[at : end - 1])  # the special string is plain text but for its last character
            whole = int(np.frombuffer(steps, np.int8)[: begin - at].sum())
            out += [steps, np.array([whole + 1 - int(np.frombuffer(steps, np.int8).sum())], np.int8).tobytes()]
            at = end
        return b"".join([*out, self._plain(text[at:])])


_LOADED: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, loaded once in a worker."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = PrefixCounter(path)
    return _LOADED[path]


def _kind(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def prefix_table(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, steps`` of every row; ``steps`` (binary) holds the counts of all prefixes and is meant to be stored."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                steps = [own.steps(t) for t in part.column(2).to_pylist()]
                totals = pa.array([int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), totals, pa.array(steps, pa.binary())], [id_col, "n_bytes", "n_tokens", "steps"])

    rows = df.select(id_col, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {_kind(df, id_col)}, n_bytes bigint, n_tokens bigint, steps binary")


def longest_prefix(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    fitting = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(fitting[-1]) + 1 if len(fitting) else 0


def within_budget(table: DataFrame, budget: int) -> DataFrame:
    """A stored prefix table with ``kept_chars``: characters of the longest prefix with at most ``budget`` tokens."""
    return _answered(table, "kept_chars", lambda steps, _: longest_prefix(steps, budget), F.lit(0))


def tokens_before(table: DataFrame, place: str) -> DataFrame:
    """A stored prefix table with ``tokens_before``: the count of the prefix of ``place`` characters (a column; null: none; beyond the end: the whole text)."""
    count = lambda steps, at: int(np.frombuffer(steps, np.int8)[: max(0, at or 0)].sum(dtype=np.int64))
    return _answered(table, "tokens_before", count, F.col(place))


def _answered(table: DataFrame, name: str, answer, place) -> DataFrame:
    ship(table.sparkSession)
    rest = [c for c in table.columns if c not in ("steps", name)]
    kinds = dict(table.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [answer(s, at) for s, at in zip(batch.column(len(rest)).to_pylist(), batch.column(len(rest) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(found, pa.int64())], [*rest, name])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"{name} bigint"])
    return table.select(*rest, "steps", place.cast("long").alias("_place")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, vocabulary: str, *, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit, kept_chars`` of every row.

    ``kept_chars`` are the characters of the longest prefix within the limit: all of a text that is not over it.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                totals, kept = [], []
                for t in part.column(2).to_pylist():
                    steps = own.steps(t)
                    totals.append(int(np.frombuffer(steps, np.int8).sum(dtype=np.int64)))
                    kept.append(longest_prefix(steps, limit) if totals[-1] > limit else len(steps))
                over = pa.array([n > limit for n in totals], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(totals, pa.int64()), over, pa.array(kept, pa.int64())], [id_col, "n_bytes", "n_tokens", "over_limit", "kept_chars"])

    rows = df.select(id_col, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {_kind(df, id_col)}, n_bytes bigint, n_tokens bigint, over_limit boolean, kept_chars bigint")
