"""Gradient-boosted trees with logistic loss over dense features, and isotonic calibration, in numpy.

Training runs on the driver over a bounded sample; a model is a small list of arrays that travels with the function that
applies it.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Histogram trees of fixed depth: inner nodes in heap order, leaves at the last level."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base = 0.0
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        x, y = np.asarray(x, float), np.asarray(y, float)
        rate = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base, self.model = float(np.log(rate / (1 - rate))), []
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        coded = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
        score = np.full(len(y), self.base)
        features, wide = x.shape[1], self.bins + 1
        inner = 2**self.depth - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-9)
                choice = np.full((many, 2), -1)
                at = node - first
                for f in range(features):
                    if not len(edges[f]):
                        continue
                    cell = at * wide + coded[:, f]
                    gs = np.bincount(cell, g, many * wide).reshape(many, wide).cumsum(1)
                    hs = np.bincount(cell, h, many * wide).reshape(many, wide).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    left, right = hs[:, :-1], ht - hs[:, :-1]
                    gain = gs[:, :-1] ** 2 / (left + 1) + (gt - gs[:, :-1]) ** 2 / (right + 1) - gt**2 / (ht + 1)
                    gain[(left < self.least) | (right < self.least)] = -1
                    gain[:, len(edges[f]) :] = -1
                    k = gain.argmax(1)
                    top = gain[np.arange(many), k]
                    better = top > best
                    best[better], choice[better, 0], choice[better, 1] = top[better], f, k[better]
                for m in range(many):
                    if choice[m, 0] >= 0:
                        feature[first + m], limit[first + m] = choice[m, 0], edges[choice[m, 0]][choice[m, 1]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            score += value[leaf]
            self.model.append((feature, limit, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, limit, value in self.model:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] > limit[node])
            score += value[node - len(feature)]
        return 1 / (1 + np.exp(-score))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (raw score, calibrated probability), both rising."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first raw, last raw
    for r, v in zip(raw[order].tolist(), np.asarray(y, float)[order].tolist()):
        blocks.append([v, 1.0, r, r])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            s, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], last]
    xs = [v for b in blocks for v in (b[2], b[3])]
    ys = [b[0] / b[1] for b in blocks for _ in range(2)]
    return np.array(xs), np.array(ys)
