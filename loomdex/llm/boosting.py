"""Gradient-boosted regression trees on binned features, and monotone calibration. Training is on the driver, on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays: a prediction is `depth` gathers a tree, whatever the number of rows."""

    base: float
    edges: list[np.ndarray]  # of each feature
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # a row goes right if its bin is above
    leaf: np.ndarray  # trees x leaves
    depth: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(e, x[:, j], side="left")
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = (1 << self.depth) - 1
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += v[node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 32, least: float = 8.0, l2: float = 1.0) -> Trees:
    """Squared error; each level of a tree takes for every node the feature and bin edge that lower the error most."""
    w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    base = float(np.average(y, weights=w))
    model = Trees(base, edges, np.zeros((trees, (1 << depth) - 1), np.int32), np.full((trees, (1 << depth) - 1), 255, np.int32), np.zeros((trees, 1 << depth)), depth)
    b = model.bins(x).astype(np.int64)
    score, inner, nf = np.full(len(y), base), (1 << depth) - 1, x.shape[1]
    for t in range(trees):
        grad, node = w * (y - score), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            key = (((node - first) * nf)[:, None] + np.arange(nf)) * bins + b
            g = np.bincount(key.ravel(), np.repeat(grad, nf), n * nf * bins).reshape(n, nf, bins).cumsum(2)
            h = np.bincount(key.ravel(), np.repeat(w, nf), n * nf * bins).reshape(n, nf, bins).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(h < least) | (ht - h < least)] = 0
            best = gain.reshape(n, -1).argmax(1)
            for i in range(n):
                if gain[i].flat[best[i]] > 1e-9:
                    model.feature[t, first + i], model.cut[t, first + i] = divmod(int(best[i]), bins)
            f, c = model.feature[t][node], model.cut[t][node]
            node = 2 * node + 1 + (b[np.arange(len(y)), f] > c)
        node -= inner
        s, h = np.bincount(node, grad, 1 << depth), np.bincount(node, w, 1 << depth)
        model.leaf[t] = rate * s / (h + l2)
        score += model.leaf[t][node]
    return model


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone curve from score to y that is nearest in squares (pooling neighbours that run against it)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, score sum
    for s, v, w in zip(score[order], y[order], weight[order]):
        blocks.append([v, w, s * w])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, z = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [(p[0] * p[1] + m * n) / (p[1] + n), p[1] + n, p[2] + z]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])
