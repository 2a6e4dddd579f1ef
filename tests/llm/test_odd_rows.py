"""Nulls in every column, repeated rows, empty and very long texts, and columns named like results, through every operator and stage."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from cutline.llm import chunk_dedup, decontaminate, language, licenses, lm_scoring, near_copies, packing, quality, simhash, suffix_dedup, token_files


def sentence(rng, n):
    return " ".join(f"{rng.choice('abcdefg')}{rng.randrange(400)}" for _ in range(n))


def rows():
    rng = random.Random(11)
    long = "\n".join(f"{sentence(rng, 20)} the end." for _ in range(1500))
    plain = "\n".join(f"{sentence(rng, 20)} the end." for _ in range(6))
    other = "\n".join(f"{sentence(rng, 20)} the end." for _ in range(5))
    return [(1, plain, "en", None, 1), (1, plain, "en", None, 1), (None, plain, None, "s", None), (None, plain, None, "s", None), (2, None, "en", "s", 0), (None, None, None, None, None), (3, "", "fr", "s", 0), (4, long, "en", "s", 9), (5, other, "fr", "s", 1), (5, other + "\n" + sentence(rng, 12) + " so.", "fr", "s", 1), (6, "   \n\t ", "fr", "s", 5), (7, "word", "en", "s", 4)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def ids(df):
    return Counter(r.doc_id for r in df.collect())


EVERY = Counter(r[0] for r in rows())


def clashing(df, *names):
    for n in names:
        df = df.withColumn(n, df.n_chars)
    return df


def test_row_for_row_operators(spark, docs):
    bench = spark.createDataFrame([(None, "the end"), (1, None), (1, ""), (1, "a1 b2"), (1, "the end")], "item_id bigint, text string")
    found = {
        "op1": licenses.license_scan(clashing(docs, "licence", "n_notices", "canonical_sha256"), licenses.registry(spark)),
        "op2": suffix_dedup.remove_repeats(clashing(docs, "n_bytes", "clean_text", "kept_sha256")),
        "op3": chunk_dedup.remove_repeated_chunks(clashing(docs, "n_removed", "clean_text")),
        "op4": decontaminate.contamination(clashing(docs, "n_words", "contaminated", "clean_text"), bench),
        "op5": language.identify(clashing(docs, "lang_pred", "score", "held_out")),
        "op6": quality.quality_columns(clashing(docs, "kept", "n_words", "clean_text")),
        "op8": lm_scoring.score_documents(clashing(docs, "score", "n_tokens", "row", "codes")),
        "op9": simhash.near_duplicates(clashing(docs, "fingerprint", "component_id", "fp", "k")),
    }
    for name, df in found.items():
        assert ids(df) == EVERY, name
        for key in (1, None):  # rows equal in id and text have equal results
            own = {str({k: float(f"{v:.5g}") if isinstance(v, float) else v for k, v in r.asDict().items()}) for r in df.collect() if r.doc_id == key and r.asDict().get("n_words", 1) != 0}
            texts = {r[1] for r in rows() if r[0] == key}
            assert len(own) <= len(texts), (name, key)


def test_repeats_count_rows_not_ids(docs):
    repeated = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect() if r.text and r.text.startswith(rows()[0][1][:40])}
    assert repeated[1].n_removed == repeated[None].n_removed == repeated[1].n_bytes and repeated[1].clean_text == ""
    chunks = {r.doc_id: r for r in chunk_dedup.remove_repeated_chunks(docs).collect() if r.text and r.text.startswith(rows()[0][1][:40])}
    assert chunks[None].n_removed == 0 and chunks[1].n_removed > 0.9 * chunks[1].n_bytes  # a null id comes first


def test_packing_and_files(spark, docs, tmp_path):
    from public_tokenizers import path

    pieces = packing.pack_documents(clashing(docs, "piece", "length", "salt", "sequence_id"), path("word_bpe_49k.json")).collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == EVERY and sum(r.doc_id == 4 for r in pieces) > 20
    places = Counter((r.sequence_id, r.offset) for r in pieces)
    assert max(places.values()) == 1
    token_files.write_token_files(clashing(docs, "part", "offset", "ids"), str(tmp_path / "t"), path("byte_bpe_50k.json"))
    read = token_files.token_digests(token_files.read_token_files(spark, str(tmp_path / "t"))).collect()
    assert Counter(r.doc_id for r in read) == EVERY
    starts = sorted((r.start, r.n_tokens) for r in read)
    assert [a for a, _ in starts] == [sum(n for _, n in starts[:k]) for k in range(len(starts))]
    nulls = sorted(r.start for r in read if r.doc_id is None)
    assert nulls[0] == 0 and len(nulls) == 3


def test_one_of_each_group(docs):
    for kept in (simhash.keep_one(docs), near_copies.keep_one(docs)):
        found = [(r.doc_id, r.text) for r in kept.collect()]
        assert len(found) == len(set(found))
        texts = [t for _, t in found]
        assert texts.count(rows()[0][1]) == 1 and (1, rows()[0][1]) in found  # an id before a null
        assert sum(not (t or "").split() for t in texts) == 1


def test_language_of_odd_texts(docs):
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[6].lang_pred == "und"
    assert got[4].lang_pred in ("en", "fr")
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("empty", [False, True])
def test_whole_pipeline(spark, tmp_path, empty):
    rng = random.Random(5)
    page = lambda n: "\n".join(f"{sentence(rng, 25)} the end." for _ in range(n))
    passage = sentence(rng, 55)
    while not 256 <= len(passage) < 399:
        passage = sentence(rng, 75)
    item = sentence(rng, 30)
    shared = [page(4) + f"\n{passage} the end.\n" + page(4) for _ in range(2)]
    clean = [page(6) for _ in range(5)]
    near = clean[0].replace(clean[0].split()[40], "changed")
    table = [*rows(), *((100 + i, t, "en", "s", len(t)) for i, t in enumerate([*clean, near, *shared, f"{item} the end.\n" * 2]))]
    df = spark.createDataFrame(table, SCHEMA)
    (df.limit(0) if empty else df).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    if empty:
        assert not out
        return
    assert {100, 101, 102, 103, 104, 106, 107} <= kept and 105 not in kept and 108 not in kept  # clean ones, the near copy, the benchmark's
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = stage
        stage = function(spark, before, str(tmp_path))
        assert stage.columns == before.columns, name
    left = {r.doc_id: r.text for r in stage.collect()}
    assert passage not in left[106] and passage not in left[107] and left[101] == clean[1]
    offsets = {}
    for r in out:
        offsets.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in offsets.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
