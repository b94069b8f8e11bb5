"""Gradient-boosted trees on histograms, and isotonic calibration, in numpy.

Models are fitted on bounded samples, where their operator says, and are small
enough to travel with the tasks that score. Fitting is deterministic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            go = x[rows, np.maximum(f, 0)] <= self.cut[at]
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)


@dataclass
class Booster:
    """Logistic loss, depth-limited trees, second-order leaf values."""

    rounds: int = 60
    depth: int = 4
    rate: float = 0.15
    l2: float = 1.0
    min_weight: float = 2.0
    bins: int = 64
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(code, cuts, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += tree.apply(x)
        return self

    def _grow(self, code, cuts, g, h) -> Tree:
        feature, cut, left, right, value = [], [], [], [], []

        def node() -> int:
            for a, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, 0.0)):
                a.append(v)
            return len(feature) - 1

        stack = [(node(), np.arange(len(g)), 0)]
        while stack:
            at, rows, level = stack.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            value[at] = -self.rate * sg / (sh + self.l2)
            if level == self.depth or sh < 2 * self.min_weight:
                continue
            best, where = 1e-6, None
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                k = code[rows, j]
                gl = np.cumsum(np.bincount(k, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(k, h[rows], len(c) + 1))[:-1]
                gain = gl**2 / (hl + self.l2) + (sg - gl) ** 2 / (sh - hl + self.l2) - sg**2 / (sh + self.l2)
                gain[(hl < self.min_weight) | (sh - hl < self.min_weight)] = 0
                i = int(gain.argmax())
                if gain[i] > best:
                    best, where = gain[i], (j, i)
            if where is None:
                continue
            j, i = where
            feature[at], cut[at] = j, cuts[j][i]
            go = code[rows, j] <= i
            left[at], right[at] = node(), node()
            stack += [(left[at], rows[go], level + 1), (right[at], rows[~go], level + 1)]
        return Tree(*(np.array(a) for a in (feature, cut, left, right, value)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float64)
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.apply(x)
        return out


@dataclass
class Isotonic:
    """Pool adjacent violators: probabilities that rise with the margin.

    Between the fitted points it interpolates; every pool counts half a row of
    either class more, so no score is exactly 0 or 1.
    """

    x: np.ndarray = field(default_factory=lambda: np.zeros(1))
    y: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        if not len(margin):
            return self
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []  # sum, weight, sum of margins
        for m, v in zip(margin[order], np.asarray(y, dtype=np.float64)[order], strict=True):
            pools.append([v, 1.0, m])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
        self.x = np.array([p[2] / p[1] for p in pools])
        self.y = np.maximum.accumulate([(p[0] + 0.5) / (p[1] + 1) for p in pools])
        return self

    def apply(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin, self.x, self.y), 0.0, 1.0)
