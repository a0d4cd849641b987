"""A linear-chain conditional random field in numpy: training, forward-backward and Viterbi over many sequences at once.

Sequences are given by lists of feature ids per token (hashed to a fixed number of weights). Decoding takes
emission scores per token and works in steps of time over all sequences of a batch together, sorted by
length, so a step handles the sequences that are that long and nothing is padded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (features, labels)
    transitions: np.ndarray  # (labels, labels)
    start: np.ndarray  # (labels,)


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of sequences by falling length, and how many are longer than t for each t."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(lengths) else 0
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    return order, active


def marginals(model: Model, scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of every token; scores (tokens, labels), offsets of the sequences."""
    lengths = np.diff(offsets)
    order, active = _steps(lengths)
    begin = offsets[:-1][order]
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    t_ = np.exp(model.transitions - model.transitions.max())
    forward = np.empty_like(e)
    prior = np.exp(model.start - model.start.max())
    a = None
    for t, n in enumerate(active):
        at = begin[:n] + t
        a = (prior if a is None else a[:n] @ t_) * e[at]
        a /= a.sum(1, keepdims=True)
        forward[at] = a
    b = np.ones((0, e.shape[1]))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        full = np.ones((n, e.shape[1]))  # sequences that end here begin with ones
        full[: len(b)] = b
        p = forward[at] * full
        forward[at] = p / p.sum(1, keepdims=True)
        b = (e[at] * full) @ t_.T
        b /= b.sum(1, keepdims=True)
    return forward


def viterbi(model: Model, scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The best label of every token; ties go to the label that comes first."""
    lengths = np.diff(offsets)
    order, active = _steps(lengths)
    begin = offsets[:-1][order]
    back = np.zeros(scores.shape, np.int8)
    best = np.zeros((len(lengths), scores.shape[1]))
    for t, n in enumerate(active):
        at = begin[:n] + t
        if t == 0:
            best[:n] = model.start + scores[at]
        else:
            via = best[:n, :, None] + model.transitions
            back[at] = via.argmax(1)
            best[:n] = via.max(1) + scores[at]
    out = np.zeros(len(scores), np.int8)
    now = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        out[at] = now[:n]
        if t:
            now[:n] = back[at, now[:n]]
    return out


def emissions(weights: np.ndarray, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the weights of each token's features; every token has at least one."""
    return np.add.reduceat(weights[features], offsets[:-1], axis=0) if len(features) else np.zeros((0, weights.shape[1]))


def train(features: np.ndarray, token_offsets: np.ndarray, tags: np.ndarray, offsets: np.ndarray, labels: list[str], dim: int, epochs: int = 8, batch: int = 64, rate: float = 0.3, l2: float = 1e-6, seed: int = 1) -> Model:
    """Maximise the conditional likelihood by AdaGrad over batches of sequences; deterministic for a seed."""
    k = len(labels)
    w, tr, st = np.zeros((dim, k)), np.zeros((k, k)), np.zeros(k)
    gw, gt, gs = np.full((dim, k), 1e-3), np.full((k, k), 1e-3), np.full(k, 1e-3)
    rng = np.random.default_rng(seed)
    n = len(offsets) - 1
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, -(-n // batch))):
            if not len(part):
                continue
            tokens = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in part])
            own = np.concatenate([[0], np.cumsum(np.diff(offsets)[part])])
            count = np.diff(token_offsets)[tokens]
            ids = np.concatenate([features[token_offsets[i] : token_offsets[i + 1]] for i in tokens])
            fo = np.concatenate([[0], np.cumsum(count)])
            scores = emissions(w, ids, fo)
            model = Model(labels, w, tr, st)
            gold = np.eye(k)[tags[tokens]]
            p, pairs = _expected(model, scores, own)
            d = gold - p
            grad = np.zeros_like(w)
            np.add.at(grad, ids, np.repeat(d, count, axis=0))
            grad /= len(part)
            first = own[:-1][np.diff(own) > 0]
            inner = np.setdiff1d(np.arange(len(tokens)), first)
            gold_pairs = gold[inner - 1].T @ gold[inner] if len(inner) else np.zeros((k, k))
            dt, ds = (gold_pairs - pairs) / len(part), d[first].sum(0) / len(part)
            grad -= l2 * w
            for value, g, step in ((w, gw, grad), (tr, gt, dt), (st, gs, ds)):
                g += step * step
                value += rate * step / np.sqrt(g)
    return Model(labels, w.astype(np.float32), tr, st)


def _expected(model: Model, scores: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tokens, and the expected number of each transition, by forward-backward."""
    lengths = np.diff(offsets)
    order, active = _steps(lengths)
    begin = offsets[:-1][order]
    e = np.exp(scores - scores.max(1, keepdims=True))
    t_ = np.exp(model.transitions)
    forward, backward = np.empty_like(e), np.ones_like(e)
    a = None
    for t, n in enumerate(active):
        at = begin[:n] + t
        a = (np.exp(model.start) if a is None else a[:n] @ t_) * e[at]
        a /= a.sum(1, keepdims=True)
        forward[at] = a
    pairs = np.zeros_like(t_)
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        at = begin[:n] + t
        right = e[at + 1] * backward[at + 1]
        b = right @ t_.T
        backward[at] = b / b.sum(1, keepdims=True)
        both = forward[at][:, :, None] * t_ * right[:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
    p = forward * backward
    return p / p.sum(1, keepdims=True), pairs
