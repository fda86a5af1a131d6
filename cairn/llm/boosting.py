"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees in node arrays: a leaf points to itself, so that ``depth`` steps reach one from any root."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for rows of features; a value that is not a number goes right."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, l2: float = 1.0, bins: int = 64) -> Trees:
    """Logistic boosting. ``monotone`` has +1, 0 or -1 by feature: the margin never falls (rises) along it.

    A constrained split must order its halves' values, and all below it stays on its side of their middle.
    Without rows, or with one class only, the trees are constant.
    """
    n = len(x)
    mean = (y.sum() + 1) / (n + 2)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1) if n else np.zeros((0, x.shape[1]), int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v):
        feature.append(0), threshold.append(0.0), value.append(v), left.append(len(left)), right.append(len(right))
        return len(left) - 1

    margin = np.full(n, base)
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        best_value = lambda a, b: a / (b + l2)
        roots.append(node(0.0))
        todo = [(roots[-1], np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[at] = rate * float(np.clip(best_value(gs, hs), low, high))
            best = (1e-6, None)
            for f in range(x.shape[1]) if level < depth and len(rows) >= 20 else ():
                if not len(cuts[f]):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(cuts[f]) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(cuts[f]) + 1))[:-1]
                vl, vr = np.clip(best_value(gl, hl), low, high), np.clip(best_value(gs - gl, hs - hl), low, high)
                gain = lambda v, a, b: v * a - v * v * (b + l2) / 2
                score = gain(vl, gl, hl) + gain(vr, gs - gl, hs - hl) - gain(value[at] / rate, gs, hs)
                score[(hl < 1) | (hs - hl < 1) | (monotone[f] * (vr - vl) < 0)] = 0
                k = int(score.argmax())
                if score[k] > best[0]:
                    best = (float(score[k]), (f, k, float(vl[k]), float(vr[k])))
            if best[1] is None:
                margin[rows] += value[at]
                continue
            f, k, vl, vr = best[1]
            feature[at], threshold[at] = f, float(cuts[f][k])
            left[at], right[at] = node(0.0), node(0.0)
            goes = binned[rows, f] <= k
            middle = (vl + vr) / 2
            lows, highs = ((low, middle), (middle, high)) if monotone[f] > 0 else ((middle, high), (low, middle)) if monotone[f] < 0 else ((low, high), (low, high))
            todo += [(left[at], rows[goes], level + 1, *lows), (right[at], rows[~goes], level + 1, *highs)]
    arrays = [np.array(a) for a in (roots, feature, threshold, left, right, value)]
    return Trees(arrays[0].astype(int), arrays[1].astype(int), arrays[2].astype(float), arrays[3].astype(int), arrays[4].astype(int), arrays[5].astype(float), base, depth)
