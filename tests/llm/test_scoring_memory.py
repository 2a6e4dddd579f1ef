"""Scoring keeps states only; encoding tells rare tokens apart."""

import tracemalloc
from collections import Counter

import numpy as np

from cutline.llm import lm_scoring, recurrent


def weights(seed=0):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, (recurrent.CLASSES, recurrent.MEMBERS)).astype(float)
    w = recurrent.initial(np.append(counts.sum(axis=1), 9.0), counts)
    return w | {k: rng.standard_normal(w[k].shape).astype(np.float32) * 0.3 for k in ("out", "word")}


def test_states_without_history():
    w, rng = weights(), np.random.default_rng(1)
    rows, state = rng.integers(0, 4000, (7, 30)), np.zeros((30, recurrent.STATE), np.float32)
    assert np.array_equal(recurrent.run(w, state, rows, None)[0], recurrent.run(w, state, rows, None, history=False)[0])


def test_scoring_holds_no_history_of_gates():
    """What a step leaves but its states is not needed again; before, it was held for all steps, 36 MB here."""
    w, rows = weights(), np.random.default_rng(2).integers(0, 4000, (64, 1024))
    tracemalloc.start()
    recurrent.run(w, np.zeros((1024, recurrent.STATE), np.float32), rows, None, history=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20, peak


def test_rare_tokens_of_each_text(spark):
    known = lm_scoring.Vocabulary([b"a", lm_scoring.END], np.array([5, 3]), (8, 2))
    texts = ["a b b c", None, "", "a", "B c " + "x" * 40, "y"]
    rows = spark.createDataFrame([(k, t, k % 2 == 0) for k, t in enumerate(texts)], "id bigint, text string, held_out boolean").repartition(2)
    for r in lm_scoring.encode(rows, spark.sparkContext.broadcast(known)).collect():
        want = Counter(map(lm_scoring.key_of, lm_scoring.words_of(texts[r.id])))
        del want[b"a"]
        assert {bytes(x.token): x.n for x in r.rare} == want and r.held_out == (r.id % 2 == 0)


def test_probabilities_without_row_maxima_and_where_weights_need_them():
    """A bound of the weights takes the place of each row's maximum; weights too far apart keep it."""
    rng = np.random.default_rng(3)
    states = rng.uniform(-1, 1, (500, recurrent.STATE)).astype(np.float32)
    codes = rng.integers(0, recurrent.CLASSES * recurrent.MEMBERS + 50, 500)
    for size, close in ((1.0, True), (40.0, False)):
        w = weights()
        w |= {"out": w["out"] * np.float32(size), "word": w["word"] * np.float32(size)}
        assert recurrent._shifted(w["out"], w["bias"])[1] == close and (recurrent._shifted(w["word"], w["word_bias"])[1] == close).all()
        target = np.minimum(codes // recurrent.MEMBERS, recurrent.CLASSES)
        logits = states.astype(float) @ w["out"] + w["bias"]
        want = logits[np.arange(500), target] - np.logaddexp.reduce(logits, axis=1)
        for i in np.flatnonzero(target < recurrent.CLASSES):
            inside = states[i].astype(float) @ w["word"][target[i]] + w["word_bias"][target[i]]
            want[i] += inside[codes[i] % recurrent.MEMBERS] - np.logaddexp.reduce(inside)
        assert np.allclose(recurrent.log_probabilities(w, states, codes), want, rtol=1e-4, atol=1e-3)
