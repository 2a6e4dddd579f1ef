"""The pipeline's near-dedup stage against brute force over all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from cutline.llm import near_copies


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(8)
    line = "all readers of this page are asked to be kind to one another please"
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(6, 200))) + " " + line for _ in range(30)]
    texts += [edited(rng, t.split(), k) for t in texts[:20] for k in (1, 2, 3, 5)]
    texts += [texts[3], texts[3].upper(), None, "", "  \n", "one two", "One  two", "one two three four five six"]
    return list(enumerate(texts))


def groups(rows):
    """The least id of each row's group."""
    sets = {}
    for i, t in rows:
        ws = (t or "").lower().split()
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, pairs


@pytest.mark.parametrize(("common", "batch"), [(8, 10_000), (10**9, 2)])
def test_near_dedup_stage(spark, monkeypatch, common, batch):
    monkeypatch.setattr(near_copies, "COMMON", common)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        check_near_dedup(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def check_near_dedup(spark):
    rows = corpus()
    want, pairs = groups(rows)
    assert len(pairs) > 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r.root for r in near_copies.labelled(docs).collect()}
    least = {}
    for i, root in found.items():
        least[root] = min(i, least.get(root, i))
    assert {i: least[root] for i, root in found.items()} == want
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == set(want.values())
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize(("centres", "few", "tried"), [(2, 128, 256), (1, 2, 256), (1, 2, 3)])
def test_groups_beyond_the_centres(spark, monkeypatch, centres, few, tried):
    """Many near copies at the very limit, and a passage that many texts share: just the linked pairs are in one group, at every level of signatures."""
    monkeypatch.setattr(near_copies, "CENTRES", centres)
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "TRIED", tried)
    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    bases, passage = [prose(100) for _ in range(3)], prose(40)
    texts = [edited(rng, b.split(), 1) for b in bases for _ in range(40)] + [f"{prose(60)} {passage} {prose(60)}" for _ in range(40)]
    rows = list(enumerate(texts))
    want, pairs = groups(rows)
    assert len(pairs) > 1000
    found = {r.doc_id: r.root for r in near_copies.labelled(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert all((want[a] == want[b]) == (found[a] == found[b]) for a in found for b in found)


def test_no_link_is_lost_among_texts_of_common_passages(spark):
    """Texts of 12 of 24 passages, and for each another that has one passage changed: every pair that is similar enough is found, at default settings."""
    rng = random.Random(1)
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(24)]
    texts = []
    for _ in range(300):
        chosen = sorted(rng.sample(range(24), 12))
        other = list(chosen)
        other[rng.randrange(12)] = rng.choice([p for p in range(24) if p not in chosen])
        texts += [" ".join(passages[p] for p in chosen), " ".join(passages[p] for p in other)]
    sets = [near_copies.shingle_set(t) for t in texts]
    near = lambda a, b: 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))
    pairs = [(i, i + 1) for i in range(0, len(texts), 2) if near(sets[i], sets[i + 1])]
    assert len(pairs) > 250
    found = {r.doc_id: r.root for r in near_copies.labelled(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)).collect()}
    assert all(found[a] == found[b] for a, b in pairs)


@pytest.mark.parametrize("level", range(len(near_copies.LEVELS)))
def test_similar_sets_share_a_signature(level):
    rng = np.random.default_rng(level)
    for n in (1, 2, 5, 9, 10, 40, 99, 125, 300):
        for _ in range(6):
            one = rng.choice(2**32, n, replace=False).astype(np.uint32)
            cut = rng.integers(0, n // 5 + 1)
            more = rng.choice(2**32, rng.integers(0, n // 4 + 1)).astype(np.uint32)
            two = np.unique(np.r_[one[cut:], more])
            if len(two) and 9 * len(np.intersect1d(one, two)) >= 4 * (len(one) + len(two)):
                assert len(np.intersect1d(near_copies.signatures(np.unique(one), level), near_copies.signatures(two, level))), (n, cut)


def test_unlike_texts_of_a_common_passage_make_no_pairs(spark, monkeypatch):
    """100 unlike texts share a passage: beyond the pairs with its centres, only pairs with near bitmaps leave the tasks that compare them; before, all pairs did."""
    monkeypatch.setattr(near_copies, "COMMON", 10**9)
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = prose(60)
    texts = [" ".join([*passage, *prose(60)]) for _ in range(100)]
    texts.append(edited(rng, texts[50].split(), 1))
    written = {}
    keep = near_copies.keep

    def counted(df, what):
        out = keep(df, what)
        written[what] = written.get(what, 0) + out.count()
        return out

    monkeypatch.setattr(near_copies, "keep", counted)
    found = {r.doc_id: r.root for r in near_copies.labelled(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).collect()}
    assert found[50] == found[100] and len(set(found.values())) == 100
    assert written["crossing"] <= 10
