"""Logistic regression on sparse hashed features, and its calibration. Fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Rows:
    """Sparse rows by row and, for products from the left, by slot: both are sums over runs."""

    def __init__(self, slots: list[np.ndarray], values: list[np.ndarray], size: int):
        self.n, self.size = len(slots), size
        row = np.repeat(np.arange(self.n), [len(x) for x in slots])
        self.slot = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        self.value = np.concatenate(values) if values else np.zeros(0)
        self.rows, self.starts = np.unique(row, return_index=True)
        order = np.argsort(self.slot, kind="stable")
        self.row, self.turned = row[order], self.value[order]
        self.slots, self.firsts = np.unique(self.slot[order], return_index=True)

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.slot):
            out[self.rows] = np.add.reduceat(w[self.slot] * self.value, self.starts)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        if len(self.slot):
            out[self.slots] = np.add.reduceat(g[self.row] * self.turned, self.firsts)
        return out


def fit(x: Rows, y: np.ndarray, l2: float = 1e-4, steps: int = 150, rate: float = 0.3, weight: np.ndarray | None = None, pairs: tuple[Rows, Rows] | None = None, pull: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam. pairs: rows whose scores should agree; pull weighs the squared difference of their scores."""
    w, b = np.zeros(x.size), 0.0
    share = np.ones(x.n) / max(x.n, 1) if weight is None else weight / weight.sum()
    m, v, mb, vb = np.zeros(x.size), np.zeros(x.size), 0.0, 0.0
    for t in range(1, steps + 1 if x.n else 1):
        err = (sigmoid(x.dot(w) + b) - y) * share
        g, gb = x.back(err) + l2 * w, err.sum()
        if pairs is not None and pairs[0].n:
            gap = 2 * pull * (pairs[0].dot(w) - pairs[1].dot(w)) / pairs[0].n
            g += pairs[0].back(gap) - pairs[1].back(gap)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= scale * m / (np.sqrt(v) + 1e-8)
        b -= scale * mb / (np.sqrt(vb) + 1e-8)
    return w, float(b)


def platt(scores: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b): sigmoid(a * score + b) is a calibrated probability. Newton steps on smoothed targets; the identity without both labels."""
    up, n = float(y.sum()), len(y)
    if not 0 < up < n:
        return 1.0, 0.0
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (n - up + 2))
    a, b = 1.0, 0.0
    f = np.c_[scores, np.ones(n)]
    for _ in range(steps):
        p = sigmoid(f @ np.array([a, b]))
        hess = (f * (p * (1 - p))[:, None]).T @ f + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, f.T @ (p - goal))
        a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -2, 2)
    return float(a), float(b)
