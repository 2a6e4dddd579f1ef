"""Vector codes, prefix token counts and tokenizer alignment against plain versions of their contracts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cutline.llm import alignment, token_counts, vector_codes

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "the", "ing", " ", "  ", "\n", "\t", "\r\n", "'", "'s", "'re", "'ll", "r", "l", "<|endoftext|>", "<|endo", "12", "é", "日本", "😀", "!", "..", "\xa0", "　", "\x1c", "\x85", "don't", "A", "aaaa", "́", "▁", "\x00", "{", ";", "<0x41>", "<s>", "ﬁ"]


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    plain = [" ".join(f"{rng.choice('abcdefg')}{rng.choice(['the', 'ing', 'über', 'x'])}{rng.randrange(40)}" for _ in range(n)) for n in (5, 50, 900, 3000)]
    return [None, "", " ", "\n", "   \n\t ", *made, *plain, plain[1], "x" * 5000, " " * 3000 + "y", "ab" * 40_000 + " end"]


def table(spark, rows):
    return spark.createDataFrame([(i % 40 if i % 7 else None, t, "clash", 1) for i, t in enumerate(rows)], "doc_id bigint, text string, n_tokens string, row int").repartition(3)


# ---- vector codes


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = [(i, tuple(int(np.floor(1024 * float(x))) for x in v), lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], ""
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[k][p] for k in range(min(entries, len(kept)))] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for row in cut:
                own[near(row[p], books[p])[1]].append(row[p])
            books[p] = [tuple(sum(c) // len(own[e]) for c in zip(*own[e])) if e in own else entry for e, entry in enumerate(books[p])]
    found = [[near(row[p], books[p]) for p in range(parts)] for row in cut]
    totals = Counter()
    for (_, _, lab), f in zip(kept, found):
        totals[lab] += sum(d for d, _ in f)
    out = [(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), totals[lab]) for (i, _, lab), f in zip(kept, found)]
    return out, hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()


def vectors(n, width, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=width) * 0.2 + (i % 5))], int(i % 3) if i % 4 else None) for i in rng.permutation(n)]
    rows += [rows[0], (rows[1][0], rows[2][1], 7), (None, rows[3][1], 7), (n, None, 1), (n + 1, rows[0][1][:-1] + [None], 1), (n + 2, rows[0][1][:-1] + [float("nan")], 1), (n + 3, rows[0][1][:-1] + [float("-inf")], 1)]
    return rows


def same_codes(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, embedding array<float>, label int, code string").repartition(3)
    want, digest = codes_by_hand(rows, **options)
    got = vector_codes.compress_vectors(df, **options).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == Counter(want)
    assert {r.codebooks_sha256 for r in got} == ({digest} if want else set())


def test_vector_codes_by_hand(spark):
    same_codes(spark, vectors(90, 12), entries=16)
    same_codes(spark, vectors(60, 20), parts=2, entries=7, rounds=2)


def test_fewer_vectors_than_entries_ties_and_none(spark):
    same_codes(spark, vectors(6, 8))
    same_codes(spark, [(i, [0.5, -0.25, 1.0, 0.0], None) for i in range(20)], entries=4)
    same_codes(spark, [(1, None, 1)])
    same_codes(spark, [])


def test_hot_labels_and_vectors_with_a_label_each(spark):
    rows = [(i, [float(i % 9), 1.0, 0.0, i / 64], 0 if i % 3 else i) for i in range(3000)]
    same_codes(spark, rows, entries=8, rounds=1)


def test_vectors_of_other_lengths_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], "vec_id bigint, embedding array<float>, label int")
    with pytest.raises(Exception, match="differ in length"):
        vector_codes.compress_vectors(df).collect()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress_vectors(df.limit(1), parts=3)


@pytest.mark.parametrize("width", [1, 2, 3, 7, 16, 33])
@pytest.mark.parametrize("spread", [3, 1000, 1 << 24])
def test_bounds_never_lose_a_nearest_entry(width, spread):
    rng = np.random.default_rng(width)
    book, rows = rng.integers(-spread, spread + 1, (100, width)), rng.integers(-spread, spread + 1, (300, width))
    rows[:50] = book[:50]
    entry, distance, measured = vector_codes.SegmentBounds(book).nearest(rows)
    every = ((rows[:, None] - book[None]) ** 2).sum(2)
    assert (distance == every.min(1)).all() and (entry == every.argmin(1)).all() and measured <= every.size


def test_bounds_drop_most_entries_of_smooth_vectors():
    rng = np.random.default_rng(0)
    smooth = lambda n: np.cumsum(rng.normal(size=(n, 64)), 1).round().astype(int) * 50
    _, _, measured = vector_codes.SegmentBounds(smooth(256)).nearest(smooth(500))
    assert measured < 0.1 * 500 * 256


# ---- token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def by_library(library, text):
    return [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(BITS), max_size=12).map("".join), st.text(st.characters(exclude_categories=["Cs"]), max_size=20)))
def test_every_prefix_has_the_librarys_count(text):
    steps = np.frombuffer(token_counts.counter(BYTE_BPE).steps(text), np.int8)
    assert np.cumsum(steps, dtype=np.int64).tolist() == by_library(Tokenizer.from_file(BYTE_BPE) if not hasattr(by_library, "t") else by_library.t, text)


by_library.t = Tokenizer.from_file(BYTE_BPE)


def test_counts_of_odd_rows(spark, library):
    rows, limit = texts(), 40
    got = token_counts.count_tokens(table(spark, rows), BYTE_BPE, limit=limit).collect()
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids) if t else 0
    want = Counter((i % 40 if i % 7 else None, len((t or "").encode()), n(t), n(t) > limit) for i, t in enumerate(rows))
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.count_tokens(table(spark, rows[:0]), BYTE_BPE).count() == 0
    with pytest.raises(Exception, match="not byte-level BPE"):
        token_counts.counter(public_tokenizers.path("word_bpe_49k.json"))


def test_a_stored_prefix_table_answers_budgets_and_places(spark, library, tmp_path):
    rows = [(i, t, 2 * i) for i, t in enumerate(x for x in texts() if len(x or "") < 400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, place int")
    token_counts.prefix_table(df, BYTE_BPE).write.parquet(str(tmp_path / "prefixes"))
    table = spark.read.parquet(str(tmp_path / "prefixes"))
    for budget in (0, 1, 7):
        for r in token_counts.within_budget(table, budget).collect():
            fitting = [k for k, n in enumerate(by_library(library, rows[r.doc_id][1] or ""), 1) if n <= budget]
            assert r.kept_chars == max(fitting, default=0), rows[r.doc_id]
    placed = table.join(df.select("doc_id", "place"), "doc_id")
    for r in token_counts.tokens_before(placed, "place").collect():
        counts = [0, *by_library(library, rows[r.doc_id][1] or "")]
        assert r.tokens_before == counts[min(2 * r.doc_id, len(counts) - 1)]


# ---- alignment


def alignment_by_hand(rows):
    a, b = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    from cutline.llm.tokens import byte_letters

    byte_of = {chr(c): x for x, c in byte_letters().items()}
    found, counts = [], Counter()
    for text in rows:
        links, groups, own_a, own_b = [], [], [], []
        if text:
            own_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            own_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if any(b"".join(x for _, x in own) != (" " + text).encode() for own in (own_a, own_b)):
                own_a, own_b = [], []
        i = j = end_a = end_b = 0
        group = ([], [])
        while i < len(own_a) and j < len(own_b):
            links.append((own_a[i][0], own_b[j][0]))
            stop_a, stop_b = end_a + len(own_a[i][1]), end_b + len(own_b[j][1])
            if stop_a <= stop_b:
                group[0].append(own_a[i][0])
                i, end_a = i + 1, stop_a
            if stop_b <= stop_a:
                group[1].append(own_b[j][0])
                j, end_b = j + 1, stop_b
            if end_a == end_b:
                groups.append(",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1])))
                group = ([], [])
        counts.update(links)
        found.append((len(own_a), len(own_b), links, groups))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(na, nb, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for na, nb, links, groups in found]


def test_alignment_by_hand(spark, monkeypatch):
    rows = texts()
    want = Counter((i % 40 if i % 7 else None, *w) for i, w in enumerate(alignment_by_hand(rows)))
    for common in (alignment.COMMON, 50, 0):
        got = alignment.align_tokenizers(table(spark, rows), BYTE_BPE, PIECES, common=common).collect()
        assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want, common
    assert alignment.align_tokenizers(table(spark, rows[:0]), BYTE_BPE, PIECES).count() == 0
    assert alignment.align_tokenizers(table(spark, [None, ""]), BYTE_BPE, PIECES).count() == 2


def test_windows_and_whole_texts_align_alike(monkeypatch):
    rows = texts()
    pair = alignment.Pair(BYTE_BPE, PIECES)
    assert pair.by_word
    plain = lambda found: [(s, d, c.tolist(), n.tolist()) for s, d, c, n in found]
    want = plain(alignment.align_texts(pair, rows))
    monkeypatch.setattr(alignment, "WINDOW", 64)
    assert plain(alignment.align_texts(pair, rows)) == want
    whole = alignment.Pair(BYTE_BPE, PIECES)
    whole.by_word = False
    assert plain(alignment.align_texts(whole, rows)) == want
