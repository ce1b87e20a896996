"""A small linear classifier on hashed features, trained in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import xxhash


def bucket(feature: str, bits: int) -> int:
    return xxhash.xxh32_intdigest(feature) & ((1 << bits) - 1)


def pack(rows: Iterable[dict[int, float]], unit: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of {bucket: value} as (indices, values, starts), scaled to length one if `unit`."""
    idx: list[int] = []
    val: list[float] = []
    starts = [0]
    for r in rows:
        norm = unit and math.sqrt(sum(v * v for v in r.values())) or 1.0
        idx += r.keys()
        val += [v / norm for v in r.values()]
        starts.append(len(idx))
    return np.array(idx, np.int64), np.array(val), np.array(starts, np.int64)


class Linear:
    """One-layer classifier; `multi` for independent labels (logistic), else one of several (softmax)."""

    def __init__(self, n_labels: int, bits: int, multi: bool = False):
        self.w = np.zeros((1 << bits, n_labels), np.float32)
        self.b = np.zeros(n_labels, np.float32)
        self.multi, self.bits = multi, bits

    def scores(self, data: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        idx, val, starts = data
        n = len(starts) - 1
        out = np.zeros((n, self.w.shape[1]))
        if len(idx):
            some = np.nonzero(np.diff(starts))[0]  # rows without features would shift the sums
            out[some] = np.add.reduceat(self.w[idx] * val[:, None], starts[some], axis=0)
        return out + self.b

    def probabilities(self, data: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        z = self.scores(data)
        if self.multi:
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, data: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray | None = None, epochs: int = 20, rate: float = 0.5, decay: float = 1e-5, batch: int = 64, seed: int = 7) -> Linear:
        """Adagrad on mini-batches; y: (n, labels) of 0/1."""
        idx, val, starts = data
        n = len(starts) - 1
        weight = np.ones(n) if weight is None else weight
        g2, gb2 = np.full_like(self.w, 1e-3), np.full_like(self.b, 1e-3)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(n)
            for k in range(0, n, batch):
                rows = order[k : k + batch]
                parts = [np.arange(starts[r], starts[r + 1]) for r in rows]
                at = np.concatenate(parts)
                own = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
                sub = (idx[at], val[at], np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
                err = (self.probabilities(sub) - y[rows]) * weight[rows][:, None]
                cols, inv = np.unique(idx[at], return_inverse=True)
                each = err[own] * val[at][:, None]
                grad = np.stack([np.bincount(inv, each[:, k], len(cols)) for k in range(each.shape[1])], 1).astype(np.float32)
                grad += decay * self.w[cols]
                g2[cols] += grad * grad
                self.w[cols] -= rate * grad / np.sqrt(g2[cols])
                gb = err.sum(0)
                gb2 += gb * gb
                self.b -= rate * gb / np.sqrt(gb2)
        return self
