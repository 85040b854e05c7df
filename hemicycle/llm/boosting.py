"""Small gradient boosting for binary labels: depth-limited trees on binned features, logistic loss, Platt calibration."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Fitted on a bounded sample in one process; scoring is vectorised over rows and runs inside tasks."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.bias, self.trees, self.scale = 0.0, [], (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Every fourth row is held out for the calibration."""
        held = np.arange(len(y)) % 4 == 3
        self._grow(x[~held], y[~held].astype(float))
        self._calibrate(self.raw(x[held]), y[held].astype(float))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray) -> None:
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], 1) if n else x.astype(int)
        p = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
        self.bias = float(np.log(p / (1 - p)))
        f = np.full(n, self.bias)
        for _ in range(self.rounds if n else 0):
            prob = 1 / (1 + np.exp(-f))
            grad, hess = y - prob, np.maximum(prob * (1 - prob), 1e-6)
            node = np.zeros(n, int)
            size = 2 ** self.depth
            feature, cut = np.zeros(size - 1, int), np.full(size - 1, np.inf)
            for level in range(self.depth):
                base, m = 2 ** level - 1, 2 ** level
                best = np.full(m, 1e-9)
                for j in range(d):
                    if not len(cuts[j]):
                        continue
                    at, k = node * (self.bins + 1) + code[:, j], m * (self.bins + 1)
                    g = np.bincount(at, grad, k).reshape(m, -1).cumsum(1)
                    h = np.bincount(at, hess, k).reshape(m, -1).cumsum(1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = (g ** 2 / (h + self.l2) + (gt - g) ** 2 / (ht - h + self.l2) - gt ** 2 / (ht + self.l2))
                    gain = gain[:, :len(cuts[j])]
                    b = gain.argmax(1)
                    top = gain[np.arange(m), b]
                    for i in np.flatnonzero(top > best):
                        best[i], feature[base + i], cut[base + i] = top[i], j, cuts[j][b[i]]
                node = 2 * node + (x[np.arange(n), feature[base + node]] > cut[base + node])
            leaf = np.bincount(node, grad, size) / (np.bincount(node, hess, size) + self.l2) * self.rate
            self.trees.append((feature, cut, leaf))
            f += leaf[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                at = 2 ** level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            f += leaf[node]
        return f

    def _calibrate(self, f: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling: p = sigmoid(a * raw + b) by Newton steps on the held-out rows."""
        a, b = 1.0, 0.0
        if len(y) and 0 < y.sum() < len(y):
            target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
            for _ in range(25):
                p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
                w = np.maximum(p * (1 - p), 1e-6)
                g = np.array([((target - p) * f).sum(), (target - p).sum()])
                h = np.array([[(w * f * f).sum() + 1e-3, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-3]])
                step = np.linalg.solve(h, g)
                a, b = a + step[0], b + step[1]
        self.scale = (float(a), float(b)) if a > 0 else (1.0, 0.0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -50, 50)))

    def threshold(self, p: np.ndarray, y: np.ndarray, precision: float, floor: float) -> float:
        """Smallest calibrated score (at least ``floor``) from which the rows reach ``precision``."""
        order = np.argsort(-p, kind="stable")
        hit = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        ok = np.flatnonzero(hit >= precision)
        return max(floor, float(p[order][ok[-1]])) if len(ok) else 1.1
