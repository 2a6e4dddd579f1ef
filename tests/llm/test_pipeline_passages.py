"""The pipeline's suffix-array stage on passages of just over 50 words."""

import random

import corpus_pipeline


def test_passages_of_51_words_are_removed(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(1000, 99999)) for _ in range(n))
    passages = [prose(51) for _ in range(5)]
    texts = [f"{prose(60)} {p} {prose(60)}" for p in passages for _ in range(3)] + [prose(150) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert all(256 <= len(p) < 398 for p in passages)
    left = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs, "").collect()}
    for i, text in enumerate(texts):
        if i < 15:
            assert passages[i // 3] not in left[i] and text[:300] in left[i] + passages[i // 3] + text
            assert len(left[i]) in range(len(text) - len(passages[i // 3]) - 6, len(text) - len(passages[i // 3]) + 1)
        else:
            assert left[i] == text
