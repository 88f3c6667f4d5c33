"""Logistic regression over hashed features, in numpy, for the classifiers of this package."""

from __future__ import annotations

from zlib import crc32

import numpy as np

DIM = 1 << 16


def index(features: list[str]) -> list[int]:
    """Feature names as indices 1..DIM-1; 0 pads."""
    return [crc32(f.encode()) % (DIM - 1) + 1 for f in features]


def matrix(rows: list[list[int]]) -> np.ndarray:
    """Index lists as one padded matrix."""
    m = max(map(len, rows), default=1)
    out = np.zeros((len(rows), m), np.int32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def scores(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Probabilities of the rows of a padded matrix."""
    return 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, epochs: int = 12, batch: int = 256, rate: float = 0.5, l2: float = 1e-6, seed: int = 7) -> np.ndarray:
    """Weights fitted by AdaGrad to (soft) labels ``y`` in 0..1."""
    rng = np.random.default_rng(seed)
    w, sq = np.zeros(DIM), np.full(DIM, 1e-6)
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            b = order[i : i + batch]
            rows = x[b]
            g = (scores(w, rows) - y[b]) * weight[b]
            grad = np.bincount(rows.ravel(), np.repeat(g, rows.shape[1]), DIM)
            at = np.flatnonzero(grad)
            grad = grad[at] / len(b) + l2 * w[at]
            sq[at] += grad * grad
            w[at] -= rate * grad / np.sqrt(sq[at])
            w[0] = 0
    return w.astype(np.float32)
