"""Language identification against a plain version with dictionaries, and its rejection by distance."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cutline.llm import language

POOLS = {
    "en": "the of and to in that with house water great reading morning".split(),
    "de": "der die und nicht straße über häuser wasser große morgen lesen zwischen".split(),
    "fr": "le de et que être maison eau grande matin lecture garçon où".split(),
    "es": "el de que los mañana casa agua grande lectura niño está para".split(),
}


def grams(text):
    """Weights of hashed byte n-grams of one text before the inverse document frequency."""
    folded = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in text.lower().encode())
    raw, out = b" " + folded + b" ", Counter()
    for k in (2, 3):
        for i in range(len(raw) - k + 1):
            value = int.from_bytes(raw[i : i + k], "big") + (1 << 24 if k == 2 else 0)
            out[(value * 2654435761 % 2**32) >> 20] += 1
    return out


def unit(vector):
    norm = math.sqrt(sum(x * x for x in vector.values()))
    return {k: x / norm for k, x in vector.items()} if norm else vector


def dot(a, b):
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def mean(vectors):
    total = Counter()
    for v in vectors:
        for k, x in v.items():
            total[k] += x
    return {k: x / len(vectors) for k, x in total.items()}


def centroids_of(vectors, k=4, rounds=10):
    middle = mean(vectors)
    seeds = [max(range(len(vectors)), key=lambda i: dot(vectors[i], middle))]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(min(range(len(vectors)), key=lambda i: max(dot(vectors[i], vectors[s]) for s in seeds)))
    found = [vectors[s] for s in seeds]
    nearest = lambda v: max(range(len(found)), key=lambda c: dot(v, found[c]))
    for _ in range(rounds):
        own = [nearest(v) for v in vectors]
        found = [unit(mean([v for v, o in zip(vectors, own) if o == c])) if c in own else found[c] for c in range(len(found))]
    own = [nearest(v) for v in vectors]
    limits = [np.quantile([dot(v, found[c]) for v, o in zip(vectors, own) if o == c], 0.01) if c in own else 0.0 for c in range(len(found))]
    return list(zip(found, limits))


def by_hand(rows):
    learn = [(t, lang) for i, t, lang in rows if i is not None and lang is not None and t and any(c.isalpha() for c in t) and zlib.crc32(str(i).encode()) % 5]
    seen = Counter(k for t, _ in learn for k in grams(t))
    idf = lambda k: math.log((1 + len(learn)) / (1 + seen[k])) + 1
    vector = lambda t: unit({k: math.log1p(n) * idf(k) for k, n in grams(t).items()})
    model = [(lang, c, limit) for lang in sorted({x for _, x in learn}) for c, limit in centroids_of([vector(t) for t, x in learn if x == lang])]
    out = []
    for _, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            out.append(("und", 0.0, True))
            continue
        scores = [dot(vector(t), c) for _, c, _ in model]
        best = max(range(len(model)), key=lambda k: scores[k])
        out.append((model[best][0], scores[best], scores[best] < model[best][2]))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    made = [(i, " ".join(rng.choice(POOLS[lang]) for _ in range(rng.randrange(6, 40))), lang) for i, lang in enumerate(rng.choice(list(POOLS)) for _ in range(160))]
    return [*made, (900, None, "en"), (901, "12 34 !", "fr"), (None, "the house of water", None), (902, "Xq zzkj wvvq qqx kzzj", None), (903, "Съешь ещё этих мягких французских булок", None), (made[0][0], made[0][1], None)]


@pytest.fixture(scope="module")
def found(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row int, doc_id bigint, text string, lang string")
    held = language.remainder("doc_id", 5) == 0
    model = language.fit(df.where(~held), "doc_id", "text", "lang")
    return {r.row: r for r in language.predict(df.repartition(3), model).collect()}


def test_predictions_by_hand(rows, found):
    want = by_hand(rows)
    for k, (lang, score, _) in enumerate(want):
        got = found[k]
        assert got.score == pytest.approx(score, abs=1e-4), k
        assert got.lang_pred == lang, k
    agree = sum(found[k].rejected == w[2] for k, w in enumerate(want))
    assert agree >= len(want) - 3  # a text at a limit may fall on either side


def test_accuracy_and_rejection_by_distance(rows, found):
    held = [k for k, (i, _, lang) in enumerate(rows[:160]) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 20 and sum(found[k].lang_pred == rows[k][2] for k in held) >= 0.95 * len(held)
    assert sum(found[k].rejected for k in range(160)) < 0.2 * 160
    for k, (i, _, _) in enumerate(rows):
        if i in (902, 903):
            assert found[k].rejected and found[k].score < 0.3
