"""A document of millions of tokens among short ones takes memory in proportion to its length."""

import tracemalloc

import numpy as np

from cutline.llm import recurrent


def learner(seed=0):
    counts = np.ones((recurrent.CLASSES, recurrent.MEMBERS))
    return recurrent.Learner(recurrent.initial(np.append(counts.sum(1), 1.0), counts, seed=seed), 0.1)


def test_a_long_text_takes_its_own_length(monkeypatch):
    rng = np.random.default_rng(1)
    documents = [rng.integers(0, 4_000, 200).astype(np.int32) for _ in range(300)] + [rng.integers(0, 4_000, 2_000_000).astype(np.int32)]
    tried = []
    monkeypatch.setattr(recurrent, "gradients", lambda w, state, before, codes, fresh, real: (tried.append(int(real.sum())) or state, {}, np.zeros(0, int)))
    tracemalloc.start()
    recurrent.train(learner(), documents)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert sum(tried) == sum(map(len, documents))


def test_windows_hold_each_lane_with_its_beginnings(monkeypatch):
    rng = np.random.default_rng(2)
    documents = [np.arange(k * 100, k * 100 + n).astype(np.int32) for k, n in enumerate(rng.integers(1, 40, 30))]
    met, starts = [], []

    def watch(w, state, before, codes, fresh, real):
        for t, k in zip(*np.nonzero(real)):
            met.append(int(codes[t, k]))
            if fresh[t, k]:
                assert before[t, k] == -1
                starts.append(int(codes[t, k]))
            elif t:
                assert before[t, k] == codes[t - 1, k]
            else:
                assert before[t, k] == codes[t, k] - 1
        return state, {}, np.zeros(0, int)

    monkeypatch.setattr(recurrent, "gradients", watch)
    recurrent.train(learner(), documents, lanes=4, window=7)
    assert sorted(met) == sorted(int(c) for d in documents for c in d) and sorted(starts) == sorted(int(d[0]) for d in documents)
