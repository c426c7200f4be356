"""Gradient-boosted trees for binary classes, on bounded samples, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of small regression trees over quantile bins. Deterministic."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.model: list[list[tuple[int, float, float]]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        """x: rows by features; y: 0 or 1. Without both classes every score is that of the class there."""
        w = np.ones(len(y)) if weight is None else weight
        p = float(np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-4, 1 - 1e-4)) if len(y) else 1e-4
        self.base, self.model = float(np.log(p / (1 - p))), []
        if len(y) == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            g, h = w * (y - q), w * q * (1 - q)
            node = np.zeros(len(y), dtype=np.int64)
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            for at in range(2**self.depth - 1):
                own = np.flatnonzero(node == at)
                if len(own) == 0:
                    continue
                gs, hs = g[own].sum(), h[own].sum()
                best, split = 1e-6, None
                for j, e in enumerate(edges):
                    if len(e) == 0:
                        continue
                    cg = np.cumsum(np.bincount(code[own, j], g[own], len(e) + 1))[:-1]
                    ch = np.cumsum(np.bincount(code[own, j], h[own], len(e) + 1))[:-1]
                    cw = np.cumsum(np.bincount(code[own, j], w[own], len(e) + 1))[:-1]
                    gain = cg**2 / (ch + self.ridge) + (gs - cg) ** 2 / (hs - ch + self.ridge) - gs**2 / (hs + self.ridge)
                    gain[(cw < self.least) | (w[own].sum() - cw < self.least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, split = gain[k], (j, k, float(e[k]))
                if split is None:
                    tree[at] = (-1, 0.0, self.rate * gs / (hs + self.ridge))
                    continue
                tree[at] = (split[0], split[2], 0.0)
                node[own] = np.where(code[own, split[0]] <= split[1], 2 * at + 1, 2 * at + 2)
            for at in range(2**self.depth - 1, len(tree)):
                own = node == at
                if own.any():
                    tree[at] = (-1, 0.0, self.rate * g[own].sum() / (h[own].sum() + self.ridge))
            self.model.append(tree)
            score += self._tree(tree, x)
        return self

    def _tree(self, tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree))
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            f = feature[node]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if len(x) == 0:
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.base + sum((self._tree(t, x) for t in self.model), np.zeros(len(x))))))
