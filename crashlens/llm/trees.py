"""Gradient-boosted trees for binary labels in numpy: histogram splits, monotonic
constraints, and a flat form (node arrays) that scores whole batches at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes one after another; ``roots`` are the trees' first nodes.

    A leaf is its own child.  Rows whose feature is not above the threshold go
    left; a missing value (NaN) goes left too.
    """

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[:, None], len(x), axis=1)
        rows = np.arange(len(x))[None, :]
        for _ in range(self.depth):
            above = x[rows, self.feature[node]] > self.threshold[node]
            node = np.where(above, self.right[node], self.left[node])
        return self.base + self.value[node].sum(axis=0)

    def probability(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        out = np.empty(len(x))
        for i in range(0, len(x), rows):
            out[i : i + rows] = 1 / (1 + np.exp(-self.raw(x[i : i + rows])))
        return out


def fit(
    x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 80, depth: int = 3, rate: float = 0.1,
    bins: int = 64, ridge: float = 1.0, least: int = 10,
) -> Forest:
    """``monotone[j]``: 1 if the score may only rise with feature j, -1 if only fall, 0 if free."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)], axis=1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    roots: list[int] = []
    nodes: list[list] = []  # feature, threshold, left, right, value

    def grow(rows, g, h, level, low, high) -> int:
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            gs, hs = g[rows], h[rows]
            whole = gs.sum() ** 2 / (hs.sum() + ridge)
            for j in range(width):
                if not len(edges[j]):
                    continue
                b = binned[rows, j]
                size = len(edges[j]) + 1
                gl, hl, cl = (np.cumsum(np.bincount(b, v, size))[:-1] for v in (gs, hs, None))
                gr, hr, cr = gs.sum() - gl, hs.sum() - hl, len(rows) - cl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole
                gain[(cl < least) | (cr < least)] = -1
                if monotone[j]:
                    vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                    gain[monotone[j] * (vr - vl) < 0] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, gl[k], hl[k], gr[k], hr[k]))
        if best[1]:
            j, k, gl, hl, gr, hr = best[1]
            middle = float(np.clip((np.clip(-gl / (hl + ridge), low, high) + np.clip(-gr / (hr + ridge), low, high)) / 2, low, high))
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[j]]
            go_left = binned[rows, j] <= k
            left = grow(rows[go_left], g, h, level + 1, *bounds[0])
            right = grow(rows[~go_left], g, h, level + 1, *bounds[1])
            nodes[me][:4] = [j, float(edges[j][k]), left, right]
        return me

    def flat() -> Forest:
        f, t, le, ri, v = (np.asarray(c) for c in zip(*nodes))
        return Forest(base, depth, np.asarray(roots), f.astype(np.int64), t, le.astype(np.int64), ri.astype(np.int64), v)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        first = len(nodes)
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-9), 0, -np.inf, np.inf))
        whole = flat()
        one = Forest(0.0, depth, np.asarray([first]), whole.feature, whole.threshold, whole.left, whole.right, whole.value)
        score += one.raw(x)
    return flat()
