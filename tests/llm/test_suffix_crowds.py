"""A passage that many different documents share must not meet in one collection."""

import random
from collections import Counter

from cutline.llm import suffix_dedup


def test_crowded_ranges_are_bounded(spark, monkeypatch):
    seen = []
    split = suffix_dedup._crowded

    def watched(ranged):
        bounded, full = split(ranged)
        seen.append((bounded.groupBy("part").count().selectExpr("max(count)").first()[0] or 0, full.count()))
        return bounded, full

    monkeypatch.setattr(suffix_dedup, "CROWD", 10)
    monkeypatch.setattr(suffix_dedup, "_crowded", watched)
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(n))
    passage = prose(64)
    texts = [f"{prose(70)} {passage} {prose(70)}" for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    left = {r.doc_id: r.clean_text for r in suffix_dedup.remove_repeats(docs).collect()}
    assert seen and seen[0][0] <= 10 and seen[0][1] > 0
    windows = Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    for i, text in enumerate(texts):
        gone = {k + j for k in range(len(text) - 399) if windows[text[k : k + 400]] > 1 for j in range(400)}
        assert gone and left[i] == "".join(c for j, c in enumerate(text) if j not in gone)
