"""Gradient-boosted trees for small tables of features, in numpy.

Logistic loss, second-order leaf values, splits on quantile bins. Equal rows
are fitted as one with its weight. Models are a few kilobytes and score a batch
of rows at once."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least
        self.base = 0.0
        #: Of each tree the feature, cut and value of its nodes in level order.
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower"), u[:-1] if len(u := np.unique(c)) <= self.bins else []])) for c in x.T]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1).astype(np.uint8)
        rows, which = np.unique(binned, axis=0, return_inverse=True)
        which = which.ravel()
        weight, hit = np.bincount(which, minlength=len(rows)).astype(float), np.bincount(which, y, len(rows))
        width = int(rows.max(initial=0)) + 1
        # Position of each feature's bin in one histogram over all features.
        at = rows.astype(np.int64) + np.arange(rows.shape[1]) * width
        score = np.full(len(rows), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(rows, at, width, cuts, weight * p - hit, weight * p * (1 - p))
            self.forest.append(tree)
            score += tree[2][leaf]
        return self

    def _grow(self, rows: np.ndarray, at: np.ndarray, width: int, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        size, columns = 2 ** (self.depth + 1) - 1, rows.shape[1]
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(g), int)
        members: dict[int, np.ndarray] = {0: np.arange(len(g))}
        for k in range(size):
            own = members.pop(k, None)
            if own is None or not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            value[k] = -self.rate * gs / (hs + self.ridge)
            if 2 * k + 2 >= size or len(own) < 2:
                continue
            where = at[own].ravel()
            gl = np.bincount(where, np.repeat(g[own], columns), columns * width).reshape(columns, width).cumsum(1)[:, :-1]
            hl = np.bincount(where, np.repeat(h[own], columns), columns * width).reshape(columns, width).cumsum(1)[:, :-1]
            gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
            gain[(hl < self.least * 0.05) | (hs - hl < self.least * 0.05)] = -1
            best = int(gain.argmax()) if gain.size else 0
            f, b = divmod(best, max(1, width - 1))
            if gain.size and gain[f, b] > 1e-6 and b < len(cuts[f]):
                feature[k], cut[k] = f, cuts[f][b]
                right = rows[own, f] > b
                members[2 * k + 1], members[2 * k + 2] = own[~right], own[right]
                node[own] = 2 * k + 1 + right
        return (feature, cut, value), node

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.forest:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]))
            score += value[node]
        return 1 / (1 + np.exp(-score))
