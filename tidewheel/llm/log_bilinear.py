"""The log-bilinear model over word classes: training by noise-contrastive estimation, and log probabilities.

Classes are 0 to n - 1; n stands for what is before a text. A context of two classes
a, b (b the nearer) predicts the vector one * R[a] + two * R[b]; a class's score is its
inner product with Q plus a bias. NCE tells a class that was seen from NOISE drawn from
the classes' frequencies, which trains scores without normalising them; all of a batch
share their noise, so its scores are one matrix product. Probabilities are normalised
exactly: log_totals() sums over all classes for whole batches of contexts at once.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

SIZE = 24
NOISE = 32
BATCH = 1024
STEP = 0.1
CLIP = np.float32(30)


@dataclass
class Weights:
    R: np.ndarray
    Q: np.ndarray
    one: np.ndarray
    two: np.ndarray
    bias: np.ndarray

    def pack(self) -> bytes:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)]).astype(np.float32).tobytes()

    @staticmethod
    def unpack(data: bytes, classes: int, size: int) -> Weights:
        flat = np.frombuffer(data, np.float32).copy()
        shapes = [(classes + 1, size), (classes, size), (size,), (size,), (classes,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return Weights(*(part.reshape(s) for part, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)))


def start(frequency: np.ndarray, size: int = SIZE, seed: int = 0) -> Weights:
    """Weights that give every context the classes' own frequencies (which sum to 1)."""
    rng = np.random.default_rng(seed)
    n = len(frequency)
    small = rng.normal(0, 0.1, (2, n + 1, size)).astype(np.float32)
    half = np.full(size, 0.5, np.float32)
    return Weights(small[0], small[1, :n] * np.float32(0.1), half, half.copy(), np.log(frequency).astype(np.float32))


def contexts(texts: list[np.ndarray], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w) for every class of every text: the two before it and itself."""
    w = np.concatenate(texts) if texts else np.empty(0, np.int64)
    w = w.astype(np.int64)
    first = np.cumsum([0, *(len(t) for t in texts[:-1])])[: len(texts)]
    b, a = np.r_[classes, w[:-1]], np.r_[classes, classes, w[:-2]][: len(w)]
    b[first] = classes
    a[first] = classes
    second = first[np.array([len(t) for t in texts], int) > 1] + 1
    a[second] = classes
    return a, b[: len(w)], w


def _gathered(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that have each index."""
    order = np.argsort(index, kind="stable")
    own = index[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    out = np.zeros((n, *rows.shape[1:]), np.float32)
    out[own[first]] = np.add.reduceat(rows[order], first)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -CLIP, CLIP)))


def train(weights: Weights, a: np.ndarray, b: np.ndarray, w: np.ndarray, frequency: np.ndarray, rng: np.random.Generator, batch: int = BATCH, noise: int = NOISE, step: float = STEP) -> None:
    """One pass over the tokens in a random order; changes the weights in place (AdaGrad)."""
    n = len(frequency)
    log_noise = np.log(frequency * noise).astype(np.float32)
    upto = np.cumsum(frequency)
    seen = {f.name: np.full_like(getattr(weights, f.name), 1e-6) for f in fields(weights)}
    order = rng.permutation(len(w))
    for k in range(0, len(w), batch):
        at = order[k : k + batch]
        ca, cb, cw = a[at], b[at], w[at]
        drawn = np.minimum(np.searchsorted(upto, rng.random(noise) * upto[-1], "right"), n - 1)
        ra, rb = weights.R[ca], weights.R[cb]
        r = weights.one * ra + weights.two * rb
        qw, qn = weights.Q[cw], weights.Q[drawn]
        up = 1 - _sigmoid((r * qw).sum(1) + weights.bias[cw] - log_noise[cw])
        down = _sigmoid(r @ qn.T + (weights.bias[drawn] - log_noise[drawn]))
        dr = up[:, None] * qw - down @ qn
        pull = _gathered(drawn, np.column_stack([down.T @ r, down.sum(0)]).astype(np.float32), n)
        push = _gathered(cw, np.column_stack([up[:, None] * r, up]).astype(np.float32), n) - pull
        slopes = {
            "Q": push[:, :-1],
            "bias": push[:, -1],
            "R": _gathered(ca, weights.one * dr, n + 1) + _gathered(cb, weights.two * dr, n + 1),
            "one": (dr * ra).sum(0),
            "two": (dr * rb).sum(0),
        }
        for name, slope in slopes.items():
            slope = slope / np.float32(len(at))
            seen[name] += slope * slope
            getattr(weights, name)[...] += np.float32(step) * slope / np.sqrt(seen[name])


def predicted(weights: Weights, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return weights.one * weights.R[a] + weights.two * weights.R[b]


def log_totals(weights: Weights, a: np.ndarray, b: np.ndarray, batch: int = 128) -> np.ndarray:
    """The log of the sum of exp(score) over all classes, for each context."""
    out = np.empty(len(a))
    for k in range(0, len(a), batch):
        scores = predicted(weights, a[k : k + batch], b[k : k + batch]) @ weights.Q.T
        scores += weights.bias
        top = scores.max(1)
        scores -= top[:, None]
        np.exp(scores, out=scores)
        out[k : k + batch] = top + np.log(scores.sum(1, dtype=np.float64))
    return out


def log_chances(weights: Weights, a: np.ndarray, b: np.ndarray, w: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """log probability of each w after a, b; totals: log_totals of all contexts, at a * (classes + 1) + b."""
    scores = np.einsum("ij,ij->i", predicted(weights, a, b), weights.Q[w]) + weights.bias[w]
    return scores - totals[a * len(weights.R) + b]
