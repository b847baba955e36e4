"""Gradient-boosted trees with monotonic constraints, scored from flat node arrays.

Fitting runs on the driver over a bounded sample of labelled rows; the fitted
model is a few kilobytes of numpy arrays that travel with the scoring tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """All trees in one set of node arrays; roots[t] is the first node of tree t."""

    roots: np.ndarray
    feature: np.ndarray  # -1 in leaves
    threshold: np.ndarray  # left if x <= threshold
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[node]
            inner = feature >= 0
            goes_left = x[rows, np.maximum(feature, 0)] <= self.threshold[node]
            node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 5.0, least: float = 5.0) -> FlatTrees:
    """Logistic loss. monotone[j] is +1, -1 or 0: the sign the margin must follow in x[:, j]."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else [np.empty(0)] * x.shape[1]
    coded = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros(x.shape, int)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf_weight(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def grow(rows: np.ndarray, level: int, low: float, high: float, grad: np.ndarray, hess: np.ndarray) -> int:
        at = len(feature)
        g_all, h_all = grad[rows].sum(), hess[rows].sum()
        for part, start in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, rate * leaf_weight(g_all, h_all, low, high))):
            part.append(start)
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                g = np.bincount(coded[rows, j], grad[rows], len(e) + 1).cumsum()[:-1]
                h = np.bincount(coded[rows, j], hess[rows], len(e) + 1).cumsum()[:-1]
                wl = np.clip(-g / (h + ridge), low, high)
                wr = np.clip(-(g_all - g) / (h_all - h + ridge), low, high)
                gain = -(g * wl + 0.5 * (h + ridge) * wl**2) - ((g_all - g) * wr + 0.5 * (h_all - h + ridge) * wr**2)
                w = np.clip(-g_all / (h_all + ridge), low, high)
                gain += g_all * w + 0.5 * (h_all + ridge) * w**2
                gain[(h < least) | (h_all - h < least) | (monotone[j] * (wr - wl) < 0)] = -1.0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k, wl[k], wr[k])
        _, j, k, wl, wr = best
        if j >= 0:
            middle = (wl + wr) / 2
            bounds = ((low, middle), (middle, high)) if monotone[j] > 0 else ((middle, high), (low, middle)) if monotone[j] < 0 else ((low, high), (low, high))
            goes = coded[rows, j] <= k
            feature[at], threshold[at] = j, float(edges[j][k])
            left[at] = grow(rows[goes], level + 1, *bounds[0], grad, hess)
            right[at] = grow(rows[~goes], level + 1, *bounds[1], grad, hess)
        return at

    def flat() -> FlatTrees:
        return FlatTrees(np.array(roots, np.int32), np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(right, np.int32), np.array(value), base, depth)

    for _ in range(trees if len(x) and 0 < y.sum() < len(y) else 0):
        p = 1.0 / (1.0 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
        one = flat()
        one.roots, one.base = one.roots[-1:], 0.0
        margin = margin + one.margin(x)
    return flat()
