"""M7: boosted trees with a softmax loss, grown from histograms.

Features are binned once by their quantiles.  A round grows one tree of fixed depth
per class and model; a level is one pass over the rows, in which every block adds
the sums of gradients and second derivatives per (model, class, node, feature, bin).
All classes of all models share the pass.  The driver sees these sums and the trees,
whose size depends on the parameters alone.  Rows keep the scores of finished rounds,
which go to the shared folder every ``KEEP`` rounds, so a lost block is rebuilt from
the last stored one with the trees since then.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.operators.blocks import Block, advanced, summed

BINS = 256
#: Rounds between two checkpoints of the rows' scores.
KEEP = 10
#: Ridge term of a leaf's value, least sum of second derivatives of a child, least gain.
RIDGE, CHILD, GAIN = 1.0, 1.0, 1e-6


@dataclass
class Trees:
    """Complete trees: feature and bin per (round, model, class, inner node), value per leaf.
    A row goes left where its bin is at most the node's."""

    cuts: list[list[np.ndarray]]  # by model and feature
    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray


def cut_points(df: DataFrame, features: Sequence[str], models: int, bins: int = BINS) -> list[list[np.ndarray]]:
    """Ascending distinct quantiles of each feature, by model: values up to the first are bin 0."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    rows = df.groupBy("model").agg(*[F.percentile_approx(c, probs, F.lit(10_000)).alias(c) for c in features]).collect()
    by = {r["model"]: r for r in rows}  # one row per model
    return [[np.unique(np.asarray(by[m][c] if m in by else [], np.float32)) for c in features] for m in range(models)]


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins by feature (row) and row of ``x`` (column)."""
    out = np.empty(x.shape[::-1], np.uint8)
    for i, c in enumerate(cuts):
        out[i] = np.searchsorted(c, x[:, i], side="left")
    return out


def routed(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node at ``depth`` (from 0 at that level) that each row reaches."""
    inner, rows = (1 << depth) - 1, np.arange(bins.shape[1])
    node, right = np.zeros(bins.shape[1], np.int64), bins[feature[:inner]] > cut[:inner, None]
    for level in range(depth):
        node = 2 * node + right[node + (1 << level) - 1, rows]
    return node


def scores(bins: np.ndarray, model: int, trees: Trees, base: np.ndarray | None = None) -> np.ndarray:
    """Summed leaf values per class and row."""
    rounds, _, classes, leaves = trees.leaf.shape
    depth = leaves.bit_length() - 1
    out = np.zeros((classes, bins.shape[1])) if base is None else base.copy()
    for r in range(rounds):
        for c in range(classes):
            out[c] += trees.leaf[r, model, c][routed(bins, trees.feature[r, model, c], trees.bin[r, model, c], depth)]
    return out


def shares(z: np.ndarray, axis: int = 1) -> np.ndarray:
    e = np.exp(z - z.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def best_splits(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, sums left, sums right) of the best split of each node, from sums per
    (..., feature, bin, 2).  Without a gain all rows go left."""
    left = np.cumsum(sums, axis=-2)
    total = left[..., :1, -1, :]
    right = total[..., None, :] - left
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + RIDGE)
    gain = worth(left) + worth(right) - worth(total)[..., None]
    gain = np.where((left[..., 1] >= CHILD) & (right[..., 1] >= CHILD), gain, -np.inf)
    flat = gain.reshape(*gain.shape[:-2], -1)
    at = flat.argmax(axis=-1)
    feature, cut = np.divmod(at, sums.shape[-2])
    none = np.take_along_axis(flat, at[..., None], -1)[..., 0] <= GAIN
    feature, cut = np.where(none, 0, feature), np.where(none, sums.shape[-2] - 1, cut)
    picked = left.reshape(*flat.shape, 2)
    low = np.take_along_axis(picked, (feature * sums.shape[-2] + cut)[..., None, None], -2)[..., 0, :]
    return feature, cut, low, total[..., 0, :] - low


def fit(rows: RDD, cuts: list[list[np.ndarray]], classes: int, rounds: int = 100, depth: int = 3, rate: float = 0.1) -> Trees:
    """``rounds`` trees per class for every model; ``rows`` are blocks of feature values."""
    models, width = len(cuts), len(cuts[0])
    bins = 1 + max(len(c) for m in cuts for c in m)
    inner, leaves = (1 << depth) - 1, 1 << depth
    trees = Trees(cuts, np.zeros((0, models, classes, inner), np.int64), np.zeros((0, models, classes, inner), np.int64), np.zeros((0, models, classes, leaves)))
    rows.unpersist()  # the bins are kept in place of the values
    rows = rows.map(lambda b: Block(b.model, binned(b.x, cuts[b.model]), b.y, b.w, b.row, np.zeros((classes, len(b.y))))).persist(StorageLevel.MEMORY_AND_DISK)
    before = None
    for r in range(rounds):
        feature, cut, leaf = np.zeros((models, classes, inner), np.int64), np.zeros((models, classes, inner), np.int64), np.zeros((models, classes, leaves))
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            since = (feature[..., :first].copy(), cut[..., :first].copy())

            def add(total: np.ndarray, b: Block, since=since, level=level, nodes=nodes) -> None:
                p = shares(b.state, 0)
                sides = [(routed(b.x, since[0][b.model, c], since[1][b.model, c], level) * bins, b.w * (p[c] - (b.y == c)),
                          b.w * np.maximum(2.0 * p[c] * (1.0 - p[c]), 1e-16)) for c in range(classes)]
                for f in range(width):
                    column = b.x[f].astype(np.int64)
                    for c, (node, gradient, second) in enumerate(sides):
                        at = node + column
                        for i, v in enumerate((gradient, second)):
                            total[b.model, c, :, f, :, i] += np.bincount(at, v, nodes * bins).reshape(nodes, bins)

            sums = summed(rows, (models, classes, nodes, width, bins, 2), add)
            if before is not None:  # the pass has made the new rows
                before.unpersist()
                before = None
            found, at, low, high = best_splits(sums)
            feature[..., first:2 * first + 1], cut[..., first:2 * first + 1] = found, at
            if level == depth - 1:
                both = np.stack([low, high], axis=-2).reshape(models, classes, leaves, 2)
                leaf = -rate * both[..., 0] / (both[..., 1] + RIDGE)
        last = Trees(cuts, feature[None], cut[None], leaf[None])
        trees = Trees(cuts, *(np.concatenate([getattr(t, n) for t in (trees, last)]) for n in ("feature", "bin", "leaf")))
        if r + 1 < rounds:
            before, rows = rows, advanced(rows, lambda b, last=last: b.with_state(scores(b.x, b.model, last, b.state)), (r + 1) % KEEP == 0)
    rows.unpersist()
    return trees


def probabilities(x: np.ndarray, model: int, trees: Trees) -> np.ndarray:
    return shares(scores(binned(x, trees.cuts[model]), model, trees), 0).T
