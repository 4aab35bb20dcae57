"""Gradient-boosted trees with monotone constraints, flattened to node arrays.

Logistic loss, histogram splits over quantile bins. ``fit`` takes a bounded
matrix (the caller's documented sample); ``Forest.margin`` scores a batch by
walking all rows down the flat arrays together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees in breadth order: node i of a tree has children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes, int16
    cut: np.ndarray  # trees x inner nodes, float64: x <= cut goes left
    value: np.ndarray  # trees x leaves, float64
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = (1 << self.depth) - 1
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, bins: int = 48,
        rate: float = 0.15, l2: float = 2.0, min_rows: int = 8) -> Forest:
    """Fit on ``x`` (rows x features) and 0/1 labels. ``monotone``: -1, 0 or 1 for each feature.

    A split on a constrained feature is taken only if its two values stand in
    the asked order; the mean of the two then bounds everything below it.
    """
    n, width = x.shape
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    inner, leaves = (1 << depth) - 1, 1 << depth
    margin = np.full(n, base)
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut, value = np.zeros(inner, np.int16), np.full(inner, np.inf), np.zeros(leaves)
        low, high = {0: -np.inf}, {0: np.inf}
        node = np.zeros(n, np.int64)
        for i in range(inner):
            here = np.flatnonzero(node == i)
            low_i, high_i = low[i], high[i]
            found = _best(binned[here], g[here], h[here], edges, monotone, l2, min_rows, low_i, high_i, bins) if len(here) >= 2 * min_rows else None
            a, b = 2 * i + 1, 2 * i + 2
            low[a] = low[b] = low_i
            high[a] = high[b] = high_i
            if found is None:
                node[here] = a  # x <= inf
                continue
            j, k, left, right = found
            feature[i], cut[i] = j, edges[j][k]
            middle = (left + right) / 2
            if monotone[j] > 0:
                high[a], low[b] = middle, middle
            elif monotone[j] < 0:
                low[a], high[b] = middle, middle
            node[here] = np.where(binned[here, j] > k, b, a)
        for leaf in range(leaves):
            here = node == inner + leaf
            if here.any():
                value[leaf] = rate * np.clip(-g[here].sum() / (h[here].sum() + l2), low[inner + leaf], high[inner + leaf])
        margin += value[node - inner]
        features.append(feature), cuts.append(cut), values.append(value)
    return Forest(np.array(features), np.array(cuts), np.array(values), depth, base)


def _best(binned, g, h, edges, monotone, l2, min_rows, low, high, bins):
    """(feature, bin, left value, right value) of the best allowed split, or None."""
    total_g, total_h = g.sum(), h.sum()
    best, gain = None, 1e-6 + total_g**2 / (total_h + l2)
    for j, e in enumerate(edges):
        if not len(e):
            continue
        k = len(e) + 1
        gl = np.cumsum(np.bincount(binned[:, j], g, k))[:-1]
        hl = np.cumsum(np.bincount(binned[:, j], h, k))[:-1]
        nl = np.cumsum(np.bincount(binned[:, j], minlength=k))[:-1]
        gr, hr = total_g - gl, total_h - hl
        left = np.clip(-gl / (hl + l2), low, high)
        right = np.clip(-gr / (hr + l2), low, high)
        worth = gl**2 / (hl + l2) + gr**2 / (hr + l2)
        ok = (nl >= min_rows) & (len(g) - nl >= min_rows)
        if monotone[j]:
            ok &= (right - left) * monotone[j] >= 0
        worth = np.where(ok, worth, -np.inf)
        at = int(worth.argmax())
        if worth[at] > gain:
            best, gain = (j, at, left[at], right[at]), worth[at]
    return best
