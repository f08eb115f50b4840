"""Gradient-boosted trees for two classes, over columns cut into at most 32 bins."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.25, l2: float = 1.0, bins: int = 32):
        self.trees, self.depth, self.rate, self.l2, self.bins = trees, depth, rate, l2, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="nearest")) if n else np.zeros(0) for j in range(d)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1) if d else np.zeros((n, 0), int)
        mean = np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.start)
        nodes = 2**self.depth - 1
        self.feature = np.zeros((self.trees, nodes), int)
        self.threshold = np.full((self.trees, nodes), np.inf)
        self.leaf = np.zeros((self.trees, 2**self.depth))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            at = np.zeros(n, int)
            for level in range(self.depth):
                base, width = 2**level - 1, 2**level
                best_gain, best = np.zeros(width), [(0, self.bins)] * width
                for j in range(d):
                    m = len(self.cuts[j]) + 1
                    key = at * m + binned[:, j]
                    gs = np.bincount(key, g, width * m).reshape(width, m).cumsum(1)
                    hs = np.bincount(key, h, width * m).reshape(width, m).cumsum(1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (ga - gs) ** 2 / (ha - hs + self.l2) - ga**2 / (ha + self.l2)
                    gain[(hs < 1e-3) | (ha - hs < 1e-3)] = 0
                    k = gain.argmax(1)
                    for w in np.nonzero(gain[np.arange(width), k] > best_gain + 1e-9)[0]:
                        best_gain[w], best[w] = gain[w, k[w]], (j, int(k[w]))
                go = np.zeros(n, int)
                for w, (j, k) in enumerate(best):
                    self.feature[t, base + w] = j
                    self.threshold[t, base + w] = self.cuts[j][k] if best_gain[w] > 0 and k < len(self.cuts[j]) else np.inf
                    rows = at == w
                    go[rows] = x[rows, j] > self.threshold[t, base + w]
                at = at * 2 + go
            gs, hs = np.bincount(at, g, 2**self.depth), np.bincount(at, h, 2**self.depth)
            self.leaf[t] = -self.rate * gs / (hs + self.l2)
            score += self.leaf[t][at]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            score += leaf[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))
