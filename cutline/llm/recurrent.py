"""A gated recurrent language model with a class-factored output softmax, in numpy.

The state reads every word by a vector of its own. The output is a softmax over
classes times a softmax over the words of the target's class, so a word costs
``classes + members`` products, not one for each word. Codes below ``classes *
members`` are words, most frequent first; ``members`` neighbours make a class. All
further codes share one more class, whose inside is not this model's.

The state runs through whole documents. Training puts documents one after another
in lanes, starts each from an empty state, carries the state from window to window
and cuts gradients at window ends (truncated backpropagation).
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np

STATE = 16
CLASSES, MEMBERS = 64, 64
#: Steps of a training window while all lanes go on, and lanes side by side; with fewer lanes windows get longer, up to ``LONGEST``.
WINDOW, LANES, LONGEST = 16, 512, 512
#: Positions of a scoring window, at most (lanes times steps).
POSITIONS = 16_384
#: Logits whose rows' maxima are within this of a common bound need no maximum of their own: their sums are normal 32-bit numbers.
NEAR = 60.0

Weights = dict[str, np.ndarray]


def initial(class_mass: np.ndarray, counts: np.ndarray, state: int = STATE, seed: int = 0) -> Weights:
    """Weights that start as unigrams: ``class_mass`` of each class, the shared one last, and ``counts`` (classes by members)."""
    classes, members = counts.shape
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {
        "read": small(classes * members + 2, 3 * state),  # the last rows: words of the shared class, the start of a document
        "gates": small(state, 2 * state),
        "fresh": small(state, state),
        "out": np.zeros((state, classes + 1), np.float32),
        "bias": np.log((class_mass + 1) / (class_mass.sum() + classes + 1)).astype(np.float32),
        "word": np.zeros((classes, state, members), np.float32),
        "word_bias": np.where(counts > 0, np.log(np.maximum(counts, 1)), -30.0).astype(np.float32),
    }


def inputs_of(w: Weights, codes: np.ndarray) -> np.ndarray:
    """Rows of ``read`` for each code; those before position 0 are ``-1``, the start."""
    kept = len(w["read"]) - 2
    return np.where(codes < 0, kept + 1, np.minimum(codes, kept))


def run(w: Weights, state: np.ndarray, rows: np.ndarray, fresh_start: np.ndarray | None, history: bool = True) -> tuple[np.ndarray, ...]:
    """States after each of ``rows`` (time by lanes, rows of ``read``), and for each step the state before, the gates, the reset state and the new content.

    ``fresh_start`` marks where a lane begins anew. Without ``history`` only the states are of every step.
    """
    steps, n = rows.shape
    size = w["gates"].shape[0]
    read = w["read"][rows]
    states, past = np.empty((steps, n, size), np.float32), steps if history else 1
    prior, kept, new = (np.empty((past, n, size), np.float32) for _ in range(3))
    gates = np.empty((past, n, 2 * size), np.float32)
    half = np.float32(0.5)  # the logistic function of x is (1 + tanh(x / 2)) / 2
    to_gates = w["gates"] * half
    read[:, :, : 2 * size] *= half
    begins = [False] * steps if fresh_start is None else fresh_start.any(axis=1).tolist()
    for t in range(steps):
        own = t if history else 0
        before, g, k, x, after = prior[own], gates[own], kept[own], new[own], states[t]
        before[:] = state
        if begins[t]:
            before[fresh_start[t]] = 0
        np.matmul(before, to_gates, out=g)
        g += read[t, :, : 2 * size]
        np.tanh(g, out=g)
        g *= half
        g += half
        np.multiply(g[:, size:], before, out=k)
        np.matmul(k, w["fresh"], out=x)
        x += read[t, :, 2 * size :]
        np.tanh(x, out=x)
        np.subtract(x, before, out=after)
        after *= g[:, :size]
        after += before
        state = after
    return states, prior, gates, kept, new


def _shifted(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``bias`` less a bound of each row of logits, and whether that is as good as taking each row's own maximum away.

    States are between -1 and 1, so no logit of states times ``weights`` passes its
    bias by more than the sum of its weights' sizes, up or down.
    """
    reach = np.abs(weights).sum(axis=-2)
    high, low = (bias + reach).max(axis=-1), (bias - reach).max(axis=-1)
    near = high - low < NEAR
    return np.where(near[..., None], bias - high[..., None], bias).astype(np.float32), near


def _soft(logits: np.ndarray, target: np.ndarray, near: bool) -> np.ndarray:
    """Log probability of each row's target; ``logits`` become probabilities. ``near``: no row needs its maximum taken away."""
    if not near:
        logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(target)), target]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    logits /= total[:, None]
    return own - np.log(total)


def _log_soft(logits: np.ndarray, target: np.ndarray, near: bool) -> np.ndarray:
    """Log probability of each row's target; ``logits`` are used up."""
    if not near:
        logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(target)), target]
    np.exp(logits, out=logits)
    return own - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def _by_class(target: np.ndarray, classes: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Positions in the order of their class, and (class, first, last) of each class that occurs but the shared one."""
    order = np.argsort(target, kind="stable")
    cuts = np.searchsorted(target[order], np.arange(classes + 1)).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _inside(w: Weights, states: np.ndarray, parts: list[tuple[int, int, int]]) -> tuple[np.ndarray, bool]:
    """Logits of the members of each row's class, and whether no row needs its maximum taken away."""
    bias, near = _shifted(w["word"], w["word_bias"])
    logits = np.empty((parts[-1][2] if parts else 0, w["word_bias"].shape[1]), np.float32)
    for c, a, b in parts:
        np.matmul(states[a:b], w["word"][c], out=logits[a:b])
        logits[a:b] += bias[c]
    return logits, all(near[c] for c, _, _ in parts)


def log_probabilities(w: Weights, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Natural-log probability of each code after its state (of its class, where the code is shared)."""
    classes, _, members = w["word"].shape
    target = np.minimum(codes // members, classes)
    bias, near = _shifted(w["out"], w["bias"])
    logits = states @ w["out"]
    logits += bias
    found = _log_soft(logits, target, bool(near))
    order, parts = _by_class(target, classes)
    logits, near = _inside(w, states[order], parts)
    own = order[: len(logits)]
    found[own] += _log_soft(logits, codes[own] % members, near)
    return found


def score(w: Weights, documents: Sequence[np.ndarray]) -> np.ndarray:
    """Natural-log probability of each document's codes; the state is carried from the first to the last."""
    sizes = np.array([len(d) for d in documents], np.int64)
    order = np.argsort(-sizes, kind="stable")
    total = np.zeros(len(documents))
    if not len(order) or not sizes[order[0]]:
        return total
    ordered = [documents[i] for i in order.tolist()]
    sizes, at = sizes[order], 0
    state = np.zeros((len(ordered), w["gates"].shape[0]), np.float32)
    last = np.full(len(ordered), -1, np.int64)
    while at < sizes[0]:
        n = int(np.searchsorted(-sizes, -at, side="left"))  # longer than ``at``
        steps = int(min(max(WINDOW, POSITIONS // n), sizes[0] - at))
        codes = np.zeros((n, steps), np.int64)
        for k in range(n):
            part = ordered[k][at : at + steps]
            codes[k, : len(part)] = part
        codes = codes.T
        before = np.concatenate([last[None, :n], codes[:-1]])
        states = run(w, state[:n], inputs_of(w, before), None, history=False)[0]
        real = at + np.arange(steps)[:, None] < sizes[None, :n]
        found = np.zeros(codes.shape)
        found[real] = log_probabilities(w, states[real], codes[real])
        total[order[:n]] += found.sum(axis=0)
        state, last, at = states[-1], codes[-1], at + steps
    return total


def gradients(w: Weights, state: np.ndarray, before: np.ndarray, codes: np.ndarray, fresh_start: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, Weights, np.ndarray]:
    """Truncated backpropagation through one window (time by lanes): the state after it, the gradients of the summed loss, and the rows of ``read`` that theirs are for.

    ``before`` is the code read at each step (-1: the start), ``codes`` the target,
    ``real`` the positions that count.
    """
    classes, size, members = w["word"].shape
    steps, n = codes.shape
    rows = inputs_of(w, before)
    states, prior, gates, kept, new = run(w, state, rows, fresh_start)
    goal, counted = codes.ravel(), real.ravel()
    order, parts = _by_class(np.where(counted, np.minimum(goal // members, classes), classes), classes)
    flat, goal, counted = states.reshape(-1, size)[order], goal[order], counted[order]
    g: Weights = {"word": np.zeros_like(w["word"]), "word_bias": np.zeros_like(w["word_bias"])}
    target = np.minimum(goal // members, classes)
    bias, near = _shifted(w["out"], w["bias"])
    error = flat @ w["out"]
    error += bias
    _soft(error, target, bool(near))
    error[np.arange(len(goal)), target] -= 1
    error[~counted] = 0
    g["out"], g["bias"] = flat.T @ error, error.sum(axis=0)
    back = error @ w["out"].T
    miss, near = _inside(w, flat, parts)
    _soft(miss, goal[: len(miss)] % members, near)
    miss[np.arange(len(miss)), goal[: len(miss)] % members] -= 1
    for c, a, b in parts:
        np.matmul(flat[a:b].T, miss[a:b], out=g["word"][c])
        np.sum(miss[a:b], axis=0, out=g["word_bias"][c])
        back[a:b] += miss[a:b] @ w["word"][c].T
    up = np.empty_like(back)
    up[order] = back
    up = up.reshape(steps, n, size)
    update, reset = gates[:, :, :size], gates[:, :, size:]
    on_new = update * (1 - new * new)
    stays = 1 - update
    on_update, on_reset = (new - prior) * update * stays, prior * reset * (1 - reset)
    begins = fresh_start.any(axis=1).tolist()
    from_new, from_gates = np.ascontiguousarray(w["fresh"].T), np.ascontiguousarray(w["gates"].T)
    down = np.zeros((n, size), up.dtype)
    pre = np.empty((steps, n, 3 * size), np.float32)
    for t in reversed(range(steps)):
        down += up[t]
        own = pre[t]
        at_new = down * on_new[t]
        own[:, 2 * size :] = at_new
        at_kept = at_new @ from_new
        np.multiply(down, on_update[t], out=own[:, :size], casting="same_kind")
        np.multiply(at_kept, on_reset[t], out=own[:, size : 2 * size], casting="same_kind")
        down *= stays[t]
        at_kept *= reset[t]
        down += at_kept
        down += own[:, : 2 * size] @ from_gates
        if begins[t]:
            down[fresh_start[t]] = 0
    flat_pre = pre.reshape(-1, 3 * size)
    g["gates"] = prior.reshape(-1, size).T @ flat_pre[:, : 2 * size]
    g["fresh"] = kept.reshape(-1, size).T @ flat_pre[:, 2 * size :]
    order = np.argsort(rows.ravel(), kind="stable")
    sorted_rows = rows.ravel()[order]
    starts = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
    g["read"] = np.add.reduceat(flat_pre[order], starts, axis=0)
    return states[-1], g, sorted_rows[starts]


class Learner:
    """Weights with step sizes by the sums of their squared gradients (Adagrad); of ``read``, only rows that occur move."""

    def __init__(self, weights: Weights, rate: float):
        self.weights, self.rate = weights, rate
        self.sums = {k: np.full_like(v, 1e-6) for k, v in weights.items()}

    def update(self, g: Weights, rows: np.ndarray) -> None:
        for k, v in g.items():
            sums, weights = (self.sums[k][rows], self.weights[k][rows]) if k == "read" else (self.sums[k], self.weights[k])
            square = v * v
            sums += square
            np.sqrt(sums, out=square)
            v *= np.float32(self.rate)
            v /= square
            weights -= v
            if k == "read":
                self.sums[k][rows], self.weights[k][rows] = sums, weights


def lanes_of(documents: Sequence[np.ndarray], lanes: int) -> list[list[np.ndarray]]:
    """Documents dealt in their order, each to the lane with the fewest codes so far."""
    dealt: list[list[np.ndarray]] = [[] for _ in range(min(lanes, len(documents)))]
    heap = [(0, k) for k in range(len(dealt))]
    for d in documents:
        size, k = heapq.heappop(heap)
        dealt[k].append(d)
        heapq.heappush(heap, (size + len(d), k))
    return dealt


def train(learner: Learner, documents: Sequence[np.ndarray], lanes: int = LANES, window: int = WINDOW) -> None:
    """One pass over all codes of ``documents``, none of them empty."""
    dealt = sorted((x for x in lanes_of(documents, lanes) if x), key=lambda x: -sum(map(len, x)))
    if not dealt:
        return
    sizes = np.array([sum(map(len, x)) for x in dealt])
    # lanes stand one after another, so a long document takes its own length only; windows are cut from there
    flat = np.concatenate([d for x in dealt for d in x]).astype(np.int32)
    first = np.cumsum([0, *sizes[:-1]])
    begins = np.zeros(len(flat), bool)
    begins[np.cumsum([0, *(len(d) for x in dealt for d in x)])[:-1]] = True
    state = np.zeros((len(dealt), learner.weights["gates"].shape[0]), np.float32)
    t, longest = 0, int(sizes[0])
    while t < longest:
        n = int(np.searchsorted(-sizes, -t, side="left"))
        stop = min(t + min(max(window, lanes * window // n), LONGEST), longest)
        steps = np.arange(t, stop)[:, None]
        real = steps < sizes[None, :n]
        at = first[None, :n] + np.where(real, steps, t)
        fresh = begins[at] & real
        codes = np.where(real, flat[at], 0).astype(np.int64)
        before = np.where(fresh, -1, np.where(real, flat[np.maximum(at - 1, 0)], 0)).astype(np.int64)
        state, g, rows = gradients(learner.weights, state[:n], before, codes, fresh, real)
        learner.update(g, rows)
        t = stop
