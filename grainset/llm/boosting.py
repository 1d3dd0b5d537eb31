"""Gradient-boosted trees with monotonic constraints, kept as flat numpy node arrays.

Fitted on a bounded sample of rows (the caller's parameter); scoring walks all rows down all
trees at once, one numpy gather for each level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray  # trees x nodes; -1 at leaves
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for every row of x."""
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[trees, node]
            right = x[rows, np.maximum(f, 0)] > self.threshold[trees, node]
            step = np.where(right, self.right[trees, node], self.left[trees, node])
            node = np.where(f < 0, node, step)
        return 1 / (1 + np.exp(-(self.base + self.value[trees, node].sum(axis=1))))


def fit_forest(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int],
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    smooth: float = 5.0,
    least: int = 10,
) -> Forest:
    """Logistic loss, histogram splits. ``monotone`` maps a feature to +1 (score may not fall
    as it rises) or -1."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) if n else np.zeros(0) for j in range(m)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], axis=1) if n else np.zeros((0, m), int)
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    size = 2 ** (depth + 1) - 1
    shape = (trees, size)
    feature = np.full(shape, -1, dtype=np.int64)
    threshold, value = np.zeros(shape), np.zeros(shape)
    left = np.tile(2 * np.arange(size) + 1, (trees, 1))
    right = left + 1
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        low, high = np.full(size, -np.inf), np.full(size, np.inf)
        for k in range(2**depth - 1):
            here = np.flatnonzero(node == k)
            g, h = grad[here].sum(), hess[here].sum()
            value[t, k] = np.clip(g / (h + smooth), low[k], high[k])
            best = None
            for j in range(m if len(here) >= 2 * least else 0):
                width = len(edges[j]) + 1
                if width < 2:
                    continue
                c = code[here, j]
                gl = np.cumsum(np.bincount(c, grad[here], width))[:-1]
                hl = np.cumsum(np.bincount(c, hess[here], width))[:-1]
                nl = np.cumsum(np.bincount(c, minlength=width))[:-1]
                a = np.clip(gl / (hl + smooth), low[k], high[k])
                b = np.clip((g - gl) / (h - hl + smooth), low[k], high[k])
                gain = gl**2 / (hl + smooth) + (g - gl) ** 2 / (h - hl + smooth) - g**2 / (h + smooth)
                ok = (nl >= least) & (len(here) - nl >= least)
                if j in monotone:
                    ok &= (b - a) * monotone[j] >= 0
                gain = np.where(ok, gain, -np.inf)
                i = int(np.argmax(gain))
                if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                    best = (gain[i], j, i, a[i], b[i])
            if best is None:
                continue
            _, j, i, a, b = best
            feature[t, k], threshold[t, k] = j, edges[j][i]
            goes_right = code[here, j] > i
            node[here] = 2 * k + 1 + goes_right
            l, r = 2 * k + 1, 2 * k + 2
            low[l], high[l], low[r], high[r] = low[k], high[k], low[k], high[k]
            if j in monotone:
                mid = (a + b) / 2
                if monotone[j] > 0:
                    high[l], low[r] = min(high[l], mid), max(low[r], mid)
                else:
                    low[l], high[r] = max(low[l], mid), min(high[r], mid)
            for child, v in ((l, a), (r, b)):
                value[t, child] = np.clip(v, low[child], high[child])
        value[t] *= rate
        margin += value[t, node]
    return Forest(feature, threshold, left, right, value, base, depth)
