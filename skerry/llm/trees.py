"""Binned decision trees in numpy, for boosting and for forests."""

from __future__ import annotations

import numpy as np

BINS = 32


class Bins:
    """Cuts each feature at quantiles of the training rows."""

    def __init__(self, x: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], axis=1).astype(np.uint8)


class Tree:
    """Splits on gradient statistics: the value of a leaf is -sum(g) / (sum(h) + penalty)."""

    def __init__(self, depth: int, penalty: float = 1.0, least: int = 5, features: int | None = None, seed: int = 0):
        self.depth, self.penalty, self.least, self.features, self.rng = depth, penalty, least, features, np.random.default_rng(seed)
        self.feature, self.cut, self.value = (np.zeros(2 ** (depth + 1), t) for t in (np.int64, np.int64, float))

    def fit(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> Tree:
        self.feature[:] = -1
        rows = {1: np.arange(len(g))}
        for node in range(1, len(self.feature)):
            if node not in rows:
                continue
            r = rows.pop(node)
            gs, hs = g[r].sum(), h[r].sum()
            self.value[node] = -gs / (hs + self.penalty)
            if node >= 2**self.depth or len(r) < 2 * self.least:
                continue
            best = (1e-9, -1, -1)
            width = binned.shape[1]
            for f in self.rng.permutation(width)[: self.features or width]:
                b = binned[r, f]
                n, a, c = (np.cumsum(np.bincount(b, w, minlength=BINS)) for w in (None, g[r], h[r]))
                gain = a**2 / (c + self.penalty) + (gs - a) ** 2 / (hs - c + self.penalty) - gs**2 / (hs + self.penalty)
                gain[(n < self.least) | (len(r) - n < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] >= 0:
                self.feature[node], self.cut[node] = best[1:]
                left = binned[r, best[1]] <= best[2]
                rows[2 * node], rows[2 * node + 1] = r[left], r[~left]
        return self

    def predict(self, binned: np.ndarray) -> np.ndarray:
        node = np.ones(len(binned), np.int64)
        for _ in range(self.depth):
            f = self.feature[node]
            inner = f >= 0
            right = binned[np.arange(len(node)), np.maximum(f, 0)] > self.cut[node]
            node = np.where(inner, 2 * node + right, node)
        return self.value[node]


class BoostedTrees:
    """Logistic loss, one tree a step."""

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2) -> BoostedTrees:
        self.bins, self.rate, self.trees = Bins(x), rate, []
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        binned, z = self.bins(x), np.full(len(y), self.base)
        for k in range(trees if len(y) else 0):
            p = 1 / (1 + np.exp(-z))
            self.trees.append(Tree(depth, seed=k).fit(binned, p - y, p * (1 - p)))
            z += rate * self.trees[-1].predict(binned)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self.bins(x)
        return 1 / (1 + np.exp(-(self.base + self.rate * sum((t.predict(binned) for t in self.trees), np.zeros(len(x))))))


class Forest:
    """Trees on resampled rows and features; the mean of their leaves' shares."""

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9) -> Forest:
        self.bins, self.trees, rng = Bins(x), [], np.random.default_rng(3)
        binned = self.bins(x)
        for k in range(trees if len(y) else 0):
            r = rng.integers(0, len(y), len(y))
            self.trees.append(Tree(depth, penalty=0.1, least=2, features=max(1, int(np.sqrt(x.shape[1]) + 1)), seed=k).fit(binned[r], -y[r].astype(float), np.ones(len(y))))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self.bins(x)
        return np.mean([t.predict(binned) for t in self.trees], axis=0) if self.trees else np.zeros(len(x))
