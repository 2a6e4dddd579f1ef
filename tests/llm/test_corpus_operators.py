"""Corpus operators against brute force, on a small fixture with nulls, ties, copies and long texts."""

import bisect
import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from cutline.llm import chunk_dedup, decontaminate, language, licenses, lm_scoring, packing, quality, recurrent, simhash, suffix_dedup, token_files, tokens

WORDS = "alpha beta gamma delta été über niño 1984 x1 the of to Kappa's e-mail ...".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def corpus():
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 300)) for _ in range(24)]
    passage = prose(rng, 120)
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 50) for _ in range(4)]
    texts += [texts[0], texts[0], passage, prose(rng, 6000), None, "", "   \n\t", "word", "a b", texts[3] + " end", texts[3].upper()]
    texts.append("Line one is here.\n\nmenu | home | <a> | #x\nclick here\nLine one is here.\nA much longer line that ends well enough.\n" * 3)
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or ""), f"clash{i}") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def licence_forms():
    """Whole licence files as they are met, with the id that they must get."""
    L = licenses.LICENCES
    own = "Copyright (c) 2020, Some One <some@one.org>\nAll rights reserved.\n\n"
    bullets = re.sub(r"(?m)^[0-9]\. ", "* ", L["BSD-2-Clause"])
    flat = lambda t: re.sub(r"\s+", " ", t)
    wrapped = lambda t: "\n".join(textwrap.wrap(flat(t), 60))
    yield "MIT", "MIT License\n\n" + own + L["MIT"]
    yield "MIT", "The MIT License (MIT)\r\n\r\n" + own + L["MIT"].replace("\n", "\r\n")
    yield "MIT", own + wrapped(L["MIT"])
    yield "MIT", L["MIT"].upper().replace('"', "”")
    yield "MIT", L["MIT"].replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")
    yield "BSD-3-Clause", "BSD 3-Clause License\n\n" + own + L["BSD-3-Clause"]
    yield "BSD-3-Clause", "New BSD License\n" + own + wrapped(L["BSD-3-Clause"])
    yield "BSD-3-Clause", own + re.sub(r"(?m)^([0-9])\. ", r"(\1) ", L["BSD-3-Clause"])
    yield "BSD-2-Clause", own + L["BSD-2-Clause"].replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR").replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS")
    yield "BSD-2-Clause", "BSD 2-Clause \"Simplified\" License\n" + own + bullets.upper()
    yield "Apache-2.0", L["Apache-2.0"].split("APPENDIX")[0]
    yield "Apache-2.0", re.sub(r"(?m)^ +", "", L["Apache-2.0"]).upper().replace("LICENSED", "LICENCED")
    yield "GPL-3.0", L["GPL-3.0"]
    yield "Zlib", "zlib License\n(C) 2001 Some One\n" + L["Zlib"].replace("acknowledgment", "acknowledgement")
    for k in L:
        yield k, L[k]
    yield None, L["MIT"].replace("Software", "Hardware")
    yield None, "MIT License"
    yield None, "The license of this text is that of the other."


def test_licences(spark, docs, empty):
    forms = list(licence_forms())
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(forms)], "doc_id bigint, text string")
    found = by_id(licenses.license_scan(df, licenses.registry(spark)))
    assert [found[i]["licence"] for i in range(len(forms))] == [k for k, _ in forms]
    assert len(licenses.LICENCES) >= 20
    lines = ["x\nReleased under the MIT License.\nLicenced under CC BY 4.0", "SPDX-License-Identifier: GPL-3.0-or-later", None, "", "  \n..."]
    more = spark.createDataFrame([(200 + i, t) for i, t in enumerate(lines)], "doc_id bigint, text string")
    row = by_id(licenses.license_scan(more.withColumn("licence", F.lit(7)), licenses.registry(spark)))
    assert [(row[200 + i]["n_notices"], row[200 + i]["notice_licences"], row[200 + i]["licensed"], row[200 + i]["licence"]) for i in range(5)] == [(2, "CC-BY-4.0,MIT", True, None), (1, "GPL-3.0", True, None)] + [(0, "", False, None)] * 3
    frame = df.unionByName(more).unionByName(docs.selectExpr("doc_id + 300 AS doc_id", "text")).toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    want = {r[0]: r for r in con.execute(licenses.ORACLE_SQL).fetchall()}
    both = licenses.license_scan(spark.createDataFrame(frame, "doc_id bigint, text string"), licenses.registry(spark)).drop("text")
    assert {r[0]: tuple(r) for r in both.collect()} == want
    assert licenses.license_scan(empty, licenses.registry(spark)).count() == 0
    twice = spark.createDataFrame([(None, "MIT License\n" + licenses.LICENCES["MIT"])] * 2, "doc_id bigint, text string")
    assert [r.licence for r in licenses.license_scan(twice, licenses.registry(spark)).collect()] == ["MIT", "MIT"]


def removed_bytes(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("crowd", [4000, 1])
def test_suffix_array_dedup(docs, empty, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    found = by_id(suffix_dedup.remove_repeats(docs))
    raws = [(t or "").encode() for _, t in corpus()]
    for (i, _), raw, gone in zip(corpus(), raws, removed_bytes(raws, 400)):
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1))
        row = found[i]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_column_wise_construction(tmp_path):
    rng = random.Random(1)
    strings = [np.array([rng.randrange(1, 3) for _ in range(rng.randrange(0, 40))], np.int64) for _ in range(12)]
    found = suffix_dedup.repeated_suffixes(strings, 5, str(tmp_path))
    seen = Counter(tuple(s[i : i + 5]) for s in strings for i in range(len(s) - 4))
    assert [list(f) for f in found] == [[i for i in range(len(s) - 4) if seen[tuple(s[i : i + 5])] > 1] for s in strings]


def test_chunk_dedup(docs, empty):
    found = by_id(chunk_dedup.remove_repeated_chunks(docs))
    first, chunks = {}, defaultdict(list)
    for i, t in corpus():
        raw, last = (t or "").encode(), 0
        for n, end in enumerate(chunk_dedup.cut_points(raw)):
            piece = raw[last:end]
            if first.setdefault(piece, (i, n)) != (i, n):
                chunks[i].append((n, last, end))
            last = end
    for i, t in corpus():
        raw = (t or "").encode()
        spans = chunk_dedup.long_runs(chunks[i], chunk_dedup.RUN)
        kept = b"".join(raw[a:b] for a, b in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(raw)]))
        assert (found[i]["n_repeated_chunks"], found[i]["n_removed"], found[i]["kept_sha256"]) == (len(chunks[i]), len(raw) - len(kept), hashlib.sha256(kept).hexdigest())
    assert all(found[i]["n_removed"] > 300 for i in (25, 26, 27))  # the shared passage
    assert chunk_dedup.remove_repeated_chunks(empty).count() == 0


def test_cut_points_resist_shifts():
    rng = random.Random(3)
    raw = prose(rng, 2000).encode()
    a = {raw[i:j] for i, j in zip([0, *chunk_dedup.cut_points(raw)], chunk_dedup.cut_points(raw))}
    moved = b"inserted " + raw
    ends = chunk_dedup.cut_points(moved)
    assert len(a & {moved[i:j] for i, j in zip([0, *ends], ends)}) > 0.95 * len(a)
    h, gear = 0, chunk_dedup._GEAR
    for b in raw[:50]:
        h = ((h << 1) + int(gear[b])) & 0xFFFF
    assert h == int(chunk_dedup.gear_hashes(raw)[49])


def test_decontamination(spark, docs, empty):
    texts = dict(corpus())
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    items = [(1, " ".join(texts[1].split()[:20])), (2, "a B"), (3, None), (4, " ... "), (5, texts[24]), (10, "A b"), (6, "not there at all")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (1_000_000, 200):
        found = by_id(decontaminate.contamination(docs, bench, block_bytes=size))
        for i, t in corpus():
            words, hit, of = split(t), set(), set()
            for item, text in items:
                w = split(text)
                n = min(13, len(w))
                windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
                for k in range(len(words) - n + 1) if n else ():
                    if tuple(words[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
                        of.add(str(item))
            digest = hashlib.sha256(",".join(sorted(of)).encode()).hexdigest()
            row = found[i]
            assert (row["n_words"], row["n_hit"], row["n_items"], row["items_sha256"], row["contaminated"]) == (len(words), len(hit), len(of), digest, bool(hit) and 20 * len(hit) >= len(words))
            assert len(split(row["clean_text"])) == len(words) - len(hit)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_language(spark, empty):
    rng = random.Random(2)
    pools = {"en": "the and with would those".split(), "fr": "une été où dans leurs".split(), "de": "über nicht eine straße und".split()}
    rows = [(i, " ".join(rng.choice(pools[g]) for _ in range(30)), g) for i in range(200) for g in [rng.choice(list(pools))]]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "the and", None), (None, "the and with", "en")]
    found = language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = {r.doc_id: r for r in found.collect()}
    right = [got[i].lang_pred == g for i, _, g in rows[:200] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200))
    assert len(right) > 20 and np.mean(right) > 0.95
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(empty).count() == 0


def test_quality(docs, empty):
    frame = docs.select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    want = {r[0]: r for r in con.execute(quality.ORACLE_SQL).fetchall()}
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert {r[0]: tuple(r) for r in quality.quality_columns(docs).select(*columns).collect()} == want
    kept = {r.doc_id for r in quality.passing(docs).collect()}
    assert kept == {i for i, r in want.items() if r[-1]}
    assert quality.quality_columns(empty).count() == 0


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def library_ids(name, text, end=0):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, vocabulary("word_bpe_49k.json")).collect()
    pieces, used = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
        used[r.sequence_id].append((r.offset, r.length))
    for i, t in corpus():
        ids = np.array(library_ids("word_bpe_49k.json", t), "<u4")
        own = [pieces[i][k] for k in range(len(pieces[i]))]
        assert [p.start for p in own] == list(range(0, len(ids), 2048))
        assert [p.ids_crc32 for p in own] == [zlib.crc32(ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)]
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) <= math.ceil(sum(r.length for r in rows) / 2048) + 1
    assert packing.pack_documents(empty, vocabulary("word_bpe_49k.json")).count() == 0


def histograms():
    rng = np.random.default_rng(0)
    yield "log-normal", np.minimum(2048, rng.lognormal(5.7, 1, 20000).astype(int) + 1)
    yield "four sizes", (rng.choice([300, 700, 1100, 1500], 20000) + rng.integers(-20, 21, 20000))
    yield "uniform 600-1100", rng.integers(600, 1101, 20000)
    yield "uniform", rng.integers(1, 2049, 20000)
    yield "thirds", rng.integers(640, 684, 9999)
    yield "above half", rng.integers(1025, 2048, 5000)
    yield "one length", np.full(1000, 777)
    yield "short", rng.integers(1, 40, 20000)
    yield "full ones", np.r_[np.full(5000, 2048), rng.integers(1, 2048, 100)]
    yield "one piece", np.array([5])
    yield "two kinds", np.r_[np.full(3000, 1030), np.full(2000, 1018), np.full(500, 9)]


@pytest.mark.parametrize(("name", "sizes"), list(histograms()), ids=[n for n, _ in histograms()])
def test_plan_is_as_tight_as_best_fit_decreasing(name, sizes):
    lengths, counts = np.unique(sizes, return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    runs = packing.plan(histogram)
    placed = Counter()
    for n, own in runs:
        assert sum(own) <= 2048
        for x in own:
            placed[x] += n
    assert placed == histogram
    rooms: list[int] = []  # best fit decreasing, a piece at a time
    for x in sorted(sizes.tolist(), reverse=True):
        at = bisect.bisect_left(rooms, x)
        room = rooms.pop(at) if at < len(rooms) else 2048
        bisect.insort(rooms, room - x)
    assert sum(n for n, _ in packing.best_fit_decreasing(histogram)) == len(rooms)
    assert math.ceil((lengths * counts).sum() / 2048) <= sum(n for n, _ in runs) <= len(rooms)
    if name == "uniform 600-1100":  # where patterns are the better plan
        assert sum(n for n, _ in packing.fitted(histogram)) < len(rooms)
    assert len(packing.slots(runs)) < 30_000


def test_hot_length_is_split_over_buckets(spark):
    rows = [(7, 0, 0, 40, 5, k) for k in range(3000)] + [(k, 0, 0, 2048 if k % 2 else 100, k, k) for k in range(150)]
    found = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint").repartition(3)
    got = packing.pack(found, bucket_rows=100).collect()
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(got) == len(rows) and len(used) <= 75 + math.ceil((3000 * 40 + 75 * 100) / 2048) + 1


def test_token_files(spark, docs, empty, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs, path, vocabulary("byte_bpe_50k.json"))
    read = token_files.read_token_files(spark, path)
    got = by_id(token_files.token_digests(read))
    at = 0
    for i, t in corpus():
        ids = np.array(library_ids("byte_bpe_50k.json", t), "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert [r.ids for r in read.where("doc_id = 7").collect()] == [library_ids("byte_bpe_50k.json", dict(corpus())[7])]
    token_files.write_token_files(empty, str(tmp_path / "none"), vocabulary("byte_bpe_50k.json"))
    assert token_files.token_digests(token_files.read_token_files(spark, str(tmp_path / "none"))).count() == 0


def test_token_files_with_other_ids_and_special_strings(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|startoftext|>", None, "", "plain", "plain"]
    df = spark.createDataFrame([(f"d{i}" if i else None, t) for i, t in enumerate(texts)] + [("d4", "plain")], "doc_id string, text string")
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = str(tmp_path / name)
        token_files.write_token_files(df, path, vocabulary(name))
        got = token_files.token_digests(token_files.read_token_files(spark, path)).collect()
        assert len(got) == 7 and dict(token_files.read_token_files(spark, path).dtypes)["doc_id"] == "string"
        assert sorted(r.n_tokens for r in got) == sorted(len(library_ids(name, t)) for t in [*texts, "plain"])
        assert next(r for r in got if r.doc_id is None).start == 0
        found = packing.pieces(df, vocabulary(name)).collect()
        assert sorted(r.ids_crc32 for r in found) == sorted(zlib.crc32(np.array(library_ids(name, t), "<u4").tobytes()) for t in [*texts, "plain"])


def test_token_files_go_by_number(spark):
    """Beyond 99,999 files, names no longer sort as the ranges do."""
    rows = spark.createDataFrame([(1, 99_999, 0, [5, 0]), (2, 99_999, 2, [0]), (3, 100_000, 0, [7, 8, 0])], "doc_id bigint, part int, offset bigint, ids array<int>")
    assert {r.doc_id: r.start for r in token_files.token_digests(rows).collect()} == {1: 0, 2: 2, 3: 3}


def test_unknown_ways_of_splitting_use_the_library():
    import json

    spec = json.loads(open(vocabulary("byte_bpe_50k.json")).read())
    assert tokens.way_of_splitting(spec) == "spaced"
    assert tokens.way_of_splitting(spec | {"normalizer": {"type": "NFKC"}}) is None
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    assert tokens.way_of_splitting(spec) is None
    other = json.loads(open(vocabulary("word_bpe_49k.json")).read())
    assert tokens.way_of_splitting(other) == "bare"
    other["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"\\w+"}
    assert tokens.way_of_splitting(other) is None


def lm_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), " "]


def lm_row(r):
    return r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]


def test_lm_scoring(docs, empty):
    found = by_id(lm_scoring.score_documents(docs.select("doc_id", "text", F.col("lang").alias("score")), vocabulary=200))
    tokens = {i: lm_tokens(t) for i, t in corpus()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        row = found[i]
        assert lm_row(row) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(row["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert row["score"] < 0
    assert lm_scoring.score_documents(empty.select("doc_id", "text")).count() == 0


def grammar(rng, n):
    """Sentences in which each word mostly decides the next: a model with a state predicts them, counts don't."""
    at, out = rng.randrange(40), []
    for _ in range(n):
        at = (at * 7 + 3) % 40 if rng.random() < 0.9 else rng.randrange(40)
        out.append(f"w{at}")
    return " ".join(out)


def test_lm_learns_and_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(i, grammar(rng, rng.randrange(1, 400))) for i in range(300)] + [(None, "w1 w2"), (7, grammar(rng, 30)), (7, "w1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, other = ([r.asDict() for r in lm_scoring.score_documents(df.repartition(n), shard=10_000).collect()] for n in (1, 5))
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["base_score"])
    for a, b in zip(sorted(one, key=key), sorted(other, key=key)):
        assert lm_row(a) == lm_row(b) and math.isclose(a["base_score"], b["base_score"], rel_tol=1e-12) and math.isclose(a["score"], b["score"], rel_tol=1e-5)
    held = [r for r in one if r["held_out"]]
    assert len(held) > 20 and sum(r["score"] for r in held) > 0.85 * sum(r["base_score"] for r in held)
    assert not next(r for r in one if r["doc_id"] is None)["held_out"]


def test_lm_learns_from_every_token(spark, monkeypatch):
    """A word that only stands at the end of long documents is learned, and so is the end token."""
    rng = random.Random(4)
    rows = [(i, " ".join(["a", "b"] * rng.randrange(40, 60)) + " x y") for i in range(200)]
    df = spark.createDataFrame(rows + [(1009, "a b x y"), (1013, "a b x z")], "doc_id bigint, text string")
    found = by_id(lm_scoring.score_documents(df, shard=10_000))
    gain = lambda i: found[i]["score"] - found[i]["base_score"]
    assert gain(1009) > 0.5


def test_lm_with_nothing_learned(spark):
    only_held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    df = spark.createDataFrame([(i, t) for i, t in zip(only_held, ["a b", "", None])], "doc_id bigint, text string")
    for r in lm_scoring.score_documents(df).collect():
        assert (r.held_out, r.n_known, r.train_tokens, r.base_score) == (True, 0, 0, 0.0) and r.score < 0


def tiny(rng):
    counts = rng.integers(1, 9, (3, 4)).astype(float)
    w = recurrent.initial(rng.random(4) * 9, counts, state=5)
    return {k: (x + 0.3 * rng.standard_normal(x.shape)).astype(np.float32) for k, x in w.items()}


def dense(w, codes):
    """Log probability by a plain forward pass, one word at a time, over all words at once."""
    size, total, last, h = w["gates"].shape[0], 0.0, 13, np.zeros(w["gates"].shape[0])
    for c in codes:
        x = w["read"][last]
        z = 1 / (1 + np.exp(-(x[: 2 * size] + h @ w["gates"])))
        new = np.tanh(x[2 * size :] + (z[size:] * h) @ w["fresh"])
        h = h + z[:size] * (new - h)
        p = np.exp(h @ w["out"] + w["bias"])
        p /= p.sum()
        every = []
        for k in range(3):
            q = np.exp(h @ w["word"][k] + w["word_bias"][k])
            every += (p[k] * q / q.sum()).tolist()
        every.append(p[3])
        assert math.isclose(sum(every), 1, rel_tol=1e-6)
        total += math.log(every[min(c, 12)])
        last = min(c, 12)
    return total


def test_recurrent_forward_pass_and_carried_state(monkeypatch):
    monkeypatch.setattr(recurrent, "POSITIONS", 8)
    monkeypatch.setattr(recurrent, "WINDOW", 3)
    rng = np.random.default_rng(0)
    w = tiny(rng)
    documents = [rng.integers(0, 15, n) for n in (1, 7, 0, 40, 3, 40)]
    want = [dense(w, d.tolist()) for d in documents]
    assert np.allclose(recurrent.score(w, documents), want, rtol=1e-4)


def test_recurrent_gradients():
    rng = np.random.default_rng(1)
    w = tiny(rng)
    before, codes = rng.integers(-1, 13, (6, 2)), rng.integers(0, 14, (6, 2))
    begins = np.zeros((6, 2), bool)
    begins[0], begins[3, 1], before[3, 1] = True, True, -1
    real = np.ones((6, 2), bool)
    real[4:, 0] = False

    def loss():
        states = recurrent.run(w, np.zeros((2, 5)), recurrent.inputs_of(w, before), begins)[0]
        return -recurrent.log_probabilities(w, states[real].astype(np.float32), codes[real]).sum()

    _, g, rows = recurrent.gradients(w, np.zeros((2, 5)), before, codes, begins, real)
    for k in w:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        place = (rows[at[0]], *at[1:]) if k == "read" else at
        old, step = w[k][place], 1e-2
        w[k][place] = old + step
        up = loss()
        w[k][place] = old - step
        assert math.isclose((up - loss()) / (2 * step), g[k][at], rel_tol=2e-2, abs_tol=2e-3), k
        w[k][place] = old


def test_lanes_hold_whole_documents_in_turn():
    documents = [np.full(n, i, np.int32) for i, n in enumerate((5, 1, 9, 2, 2, 4))]
    dealt = recurrent.lanes_of(documents, 2)
    assert sorted(int(d[0]) for x in dealt for d in x) == list(range(6))
    assert abs(sum(map(len, dealt[0])) - sum(map(len, dealt[1]))) <= 9


def test_simhash(docs, empty):
    found = by_id(simhash.near_duplicates(docs))
    fps = {}
    for i, t in corpus():
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    root = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in found.items()} == {i: (f"{fps[i]:016x}", root[i]) for i in fps}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(root.values())
    assert simhash.near_duplicates(empty).count() == 0


def test_gray_index_loses_no_link():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(4)]]))
    index = simhash.GrayIndex(values)
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in index.links(2):
        parent[find(a)] = find(b)
    own = index.values
    for a in range(len(own)):
        for b in np.flatnonzero(np.bitwise_count(own ^ own[a]) <= 2):
            assert find(a) == find(int(b))


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    base = docs.drop("kept")
    kept = pipeline.STAGES[0][1](spark, base, "")
    assert kept.columns == base.columns and 0 < kept.count() < base.count()
    one = pipeline.STAGES[1][1](spark, kept, "")
    assert one.columns == base.columns and one.count() <= kept.count()
    less = pipeline.STAGES[2][1](spark, one, "")
    assert less.columns == base.columns and less.count() == one.count()
    assert isinstance(less.toPandas(), pd.DataFrame)
