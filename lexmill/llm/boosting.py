"""Small gradient-boosted trees with logistic loss, for models fitted on bounded samples."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Symmetric trees: each level asks one question of all rows, so a leaf is a number of `depth` bits."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.base, self.parts = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        p = np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        if not n or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(m)]
        coded = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        f = np.full(n, self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            leaf, asked = np.zeros(n, np.int64), []
            for level in range(self.depth):
                best, gain = None, -1.0
                for k in range(m):
                    if not len(cuts[k]):
                        continue
                    at, size = leaf * self.bins + coded[:, k], (1 << level) * self.bins
                    gs = np.bincount(at, g, size).reshape(-1, self.bins).cumsum(axis=1)
                    hs = np.bincount(at, h, size).reshape(-1, self.bins).cumsum(axis=1)
                    left = gs[:, :-1] ** 2 / (hs[:, :-1] + self.ridge)
                    right = (gs[:, -1:] - gs[:, :-1]) ** 2 / (hs[:, -1:] - hs[:, :-1] + self.ridge)
                    total = (left + right).sum(axis=0)[: len(cuts[k])]
                    b = int(np.argmax(total))
                    if total[b] > gain + 1e-12:
                        best, gain = (k, float(cuts[k][b])), float(total[b])
                asked.append(best)
                leaf = leaf * 2 + (x[:, best[0]] > best[1])
            value = self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.ridge)
            self.parts.append((asked, value))
            f += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        f = np.full(len(x), self.base)
        for asked, value in self.parts:
            leaf = np.zeros(len(x), np.int64)
            for k, cut in asked:
                leaf = leaf * 2 + (x[:, k] > cut)
            f += value[leaf]
        return 1 / (1 + np.exp(-np.clip(f, -35, 35)))
