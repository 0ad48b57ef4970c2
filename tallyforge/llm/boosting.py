"""Gradient-boosted regression trees on the logistic loss, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Depth-limited trees in heap order: node i has children 2i + 1 and 2i + 2; a leaf's feature is -1."""

    depth: int = 3
    rate: float = 0.3
    rounds: int = 40
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray, lam: float = 1.0) -> Boosted:
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(len(y), self.base)
        splits = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 25))) for j in range(x.shape[1])]
        bins = [np.searchsorted(cuts, x[:, j], "left") for j, cuts in enumerate(splits)]  # the first cut that a value doesn't pass
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            at = np.zeros(len(y), np.int64)
            for node in range(size):
                inside = np.flatnonzero(at == node)
                if not len(inside):
                    continue
                g, h = grad[inside].sum(), hess[inside].sum()
                value[node] = self.rate * g / (h + lam)
                if node >= 2**self.depth - 1:
                    continue
                best, own = 1e-6, g * g / (h + lam)
                for j, cuts in enumerate(splits):
                    gl, hl = (np.cumsum(np.bincount(bins[j][inside], w[inside], len(cuts) + 1))[:-1] for w in (grad, hess))
                    gain = np.where((hl > 1e-3) & (hl < h - 1e-3), gl * gl / (hl + lam) + (g - gl) ** 2 / (h - hl + lam) - own, 0.0)
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], j, cuts[k]
                if feature[node] >= 0:
                    at[inside] = 2 * node + 1 + (x[inside, feature[node]] > cut[node])
            margin += value[at]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                go = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + go, at)
            out += value[at]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt scaling on held-out rows by Newton steps; a weak pull toward the identity keeps separable rows finite."""
        m = self.margin(x)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * m + b)))
            w = p * (1 - p) + 1e-9
            g = np.array([((y - p) * m).sum() - 0.1 * (a - 1), (y - p).sum() - 0.1 * b])
            h = np.array([[(w * m * m).sum() + 0.1, (w * m).sum()], [(w * m).sum(), w.sum() + 0.1]])
            step = np.linalg.solve(h, g)
            a, b = a + step[0], b + step[1]
        self.scale = (float(a), float(b))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -40, 40)))
