"""Token ids of whole texts with the ``tokenizers`` library, a bounded cache in front.

Byte-pair merges work inside pre-tokens, which never reach across the white space
that splits them; so a text's ids are the ids of its units in order, and a unit
met before need not be encoded again. Texts in which white space is not single
are encoded whole by the library; so are all texts where the vocabulary file asks
for another way of splitting than the two that this is made for.

Special strings (such as ``<|endoftext|>``) in a text become their special ids, as
the library's plain call has it; texts that hold one are encoded whole.
"""

from __future__ import annotations

import gc
import json
import re
import string
import struct

import numpy as np
import regex

#: Units of a generation that a worker remembers, beside those of the generation before that it has not met again.
CACHE_UNITS = 500_000

_DOUBLES = ("  ", "\n\n", " \n", "\n ")
#: White space other than space and line feed.
_OTHER_SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space as the vocabulary files' patterns have it, for use inside a character class.
WHITE_SPACE = " \t\n\v\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Beyond these characters a unit is left to the library's own splitting.
LATIN = re.compile(r"[\x00-\u024f]*")
#: How the two kinds of vocabulary split text into pre-tokens: byte-level ones by the library's own pattern, the others by that of their file.
SPLIT_SPACED = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_BARE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT_BARE = regex.compile(_BARE)


def byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


_LETTERS = byte_letters()

_LOADED: dict[tuple[str, int | None], "CachedTokenizer"] = {}


class _Cache(dict):
    """Remembers what ``make`` gives, up to ``most`` keys (else ``CACHE_UNITS``), and as many before those: keys in use outlast the others."""

    def __init__(self, make, most: int | None = None):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(self) >= (self.most or CACHE_UNITS):
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


def single_spaced(text: str) -> bool:
    """White space is single spaces and line feeds between words; each test runs through the text at memory speed."""
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    for run in _DOUBLES:
        if run in text:
            return False
    for space in _OTHER_SPACES:
        if space in text:
            return False
    return True


def way_of_splitting(spec: dict) -> str | None:
    """``spaced`` or ``bare`` where a vocabulary file (parsed) splits text in a way that the cache is made for."""
    model, pre, normal = spec["model"], spec["pre_tokenizer"] or {}, spec["normalizer"]
    if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    if normal is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and not model.get("end_of_word_suffix"):
        return "spaced"
    steps, normals = pre.get("pretokenizers", []), (normal or {}).get("normalizers", [])
    split, level = steps if len(steps) == 2 else ({}, {})
    if split.get("pattern") != {"Regex": _BARE} or split.get("behavior") != "Removed" or not split.get("invert"):
        return None
    if level.get("type") != "ByteLevel" or level["add_prefix_space"] or level["use_regex"]:
        return None
    return "bare" if normals == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}] else None


class CachedTokenizer:
    """Ids as little-endian unsigned 32-bit bytes; each cache holds ``units`` a generation."""

    def __init__(self, path: str, units: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.way, self.added = way_of_splitting(spec), [t["content"] for t in spec["added_tokens"]]
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.pieces = _Cache(self._merge, units)
        self.bare = _Cache(self._unit, units)
        self.spaced = _Cache(lambda word: self._unit(word, " "), units)
        self.newline = self.encode("\n")

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merge(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # every byte but the space stands for itself
            letters = piece.replace(" ", chr(_LETTERS[32]))
        else:
            letters = piece.encode().decode("latin-1").translate(_LETTERS)
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str, space: str = "") -> bytes:
        if unit.isascii():
            word = unit.rstrip(string.punctuation)
            if word.isalpha():  # one pre-token in either kind of vocabulary, and so is the punctuation after it
                if len(word) < len(unit):
                    return (self.spaced if space else self.bare)[word] + self.pieces[unit[len(word) :]]
                return self._merge(unit.lower() if self.normalizer else space + unit)
        unit = space + unit
        if not LATIN.fullmatch(unit):
            return self.encode(unit)
        parts = _SPLIT_BARE.findall(self.normalizer.normalize_str(unit)) if self.normalizer else SPLIT_SPACED.findall(unit)
        return b"".join(map(self.pieces.__getitem__, parts))

    def ids(self, text: str) -> bytes:
        """The ids of ``text``; none is added to them."""
        if not self.way or any(x in text for x in self.added):
            return self.encode(text)
        if self.normalizer:
            return b"".join(map(self.bare.__getitem__, text.replace("\n", " ").split(" ")))
        if not single_spaced(text):
            return self.encode(text) if text else b""
        out = []
        spaced = self.spaced.__getitem__
        for line in text.split("\n"):
            first, *words = line.split(" ")
            out.append(self.bare[first] + b"".join(map(spaced, words)))
        return self.newline.join(out)


def forget() -> None:
    """Give back the memory of what the worker's tokenizer remembers; it stays loaded."""
    for own in _LOADED.values():
        for cache in (own.pieces, own.bare, own.spaced):
            cache.clear()
            cache.older = {}


def tokenizer(path: str, units: int | None = None) -> CachedTokenizer:
    """The tokenizer of a vocabulary file, loaded once in a worker; another one takes its place."""
    if (path, units) not in _LOADED:
        for own in _LOADED.values():
            vars(own).clear()  # it refers to itself and is hidden from collections, so it would stay
        _LOADED.clear()
        _LOADED[path, units] = CachedTokenizer(path, units)
        gc.freeze()  # else full collections walk through the caches, again and again
    return _LOADED[path, units]


def document_ids(path: str, text: str | None, end: int = 0, units: int | None = None) -> bytes:
    """Ids of a text (null: empty) with the end id after them."""
    return (tokenizer(path, units).ids(text) if text else b"") + np.array([end], "<u4").tobytes()
