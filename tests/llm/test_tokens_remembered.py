"""Units of texts that a worker remembers: none in use is merged again, and ids are the library's."""

import weakref

import public_tokenizers
import pytest

from cutline.llm import tokens


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_in_use_outlast_others(monkeypatch, vocabulary):
    """Before, all units were forgotten at once, and those with punctuation were split by the pattern."""
    monkeypatch.setattr(tokens, "CACHE_UNITS", 50)
    own = tokens.CachedTokenizer(public_tokenizers.path(vocabulary))
    made = []
    merge = own._merge
    monkeypatch.setattr(own, "_merge", lambda piece: made.append(piece.strip()) or merge(piece))
    own.pieces.make = own._merge
    common = "Alpha beta, gamma's (delta) eps... zeta!? 9th don't can't' x, 'tis end.'s it's, a'll! 'S"
    texts = [f"{common} q{chr(97 + k % 26)}{chr(97 + k // 26)} {common}" for k in range(200)]
    for text in texts:
        assert own.ids(text) == own.encode(text), text
    assert sum(x.lower() == "alpha" for x in made) <= 2 and sum(x.lower() == "zeta" for x in made) <= 2


def test_words_with_punctuation_keep_the_library_s_ids():
    for vocabulary in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = tokens.CachedTokenizer(public_tokenizers.path(vocabulary))
        for text in ("a' b's' c'' d'll, e',s f~` g\x00 h\x7f, i\x1f j- k-l m_ n_o p1, q1. R.S. T'RE' u\n'v w'\nx, y\ny. é, ſ' z’s", "-- 'em, rock'n'roll' ok!!!\"", "one,two three;"):
            assert own.ids(text) == own.encode(text), (vocabulary, text)


def test_a_task_that_must_not_remember_leaves_no_cache_behind(monkeypatch, spark):
    """Before, the tokenizer and its caches stayed in the worker for good, even after another took their place."""
    from cutline.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    own = tokens.tokenizer(path)
    left = weakref.ref(own)
    tokens.tokenizer(path, 3)
    del own
    assert left() is None
    bounded = tokens.tokenizer(path, 3)
    for k in range(100):
        text = f"w{k} x{k}y"
        assert bounded.ids(text) == bounded.encode(text)
    assert max(len(c) + len(c.older) for c in (bounded.pieces, bounded.bare, bounded.spaced)) <= 6
    tokens.forget()
    assert not any(len(c) + len(c.older) for c in (bounded.pieces, bounded.bare, bounded.spaced))

    def held(batches):
        from cutline.llm import tokens as t

        for batch in packed(batches):
            yield batch
        (own,) = t._LOADED.values()
        assert not any(len(c) + len(c.older) for c in (own.pieces, own.bare, own.spaced))

    docs = spark.createDataFrame([(k, f"one two {k}") for k in range(20)], "doc_id long, text string").coalesce(1)
    plain = {tuple(r)[:-1] for r in packing.pieces(docs, path).collect()}
    caught = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: caught.append(f) or self)
    packing.pieces(docs, path, units=4)
    monkeypatch.undo()
    packed = caught[0]
    assert {tuple(r)[:-1] for r in docs.mapInArrow(held, "doc_id long, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint").collect()} == plain
