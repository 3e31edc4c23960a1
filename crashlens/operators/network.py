"""M4, M6: linear and one-hidden-layer classifiers by gradients over blocks.

The loss is the weighted mean cross-entropy plus ``ridge`` / (2 n) times the squared
weights (intercepts left out).  A step is one pass: every block adds its loss and
gradient, for all models at once; the driver holds the weights and runs limited-memory
quasi-Newton steps with backtracking, each model at its own pace.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark import RDD, StorageLevel

from crashlens.operators.blocks import Block, Column, summed
from crashlens.operators.boosting import shares

#: Pairs of steps that shape the next direction.
MEMORY = 10
#: Steps running that may lower the loss by less than the tolerance, the reference's default.
PATIENCE = 10
#: Rows of a block whose hidden values are held at once.
CHUNK = 4096


@dataclass
class Net:
    """Weights of each model; ``hidden`` 0: linear."""

    width: int
    hidden: int
    classes: int
    weights: np.ndarray  # (models, numbers)


def layers(v: np.ndarray, width: int, hidden: int, classes: int) -> list[np.ndarray]:
    """Weights and intercepts of the layers as views of ``v``."""
    sizes = [(width, hidden), (hidden,), (hidden, classes), (classes,)] if hidden else [(width, classes), (classes,)]
    out, at = [], 0
    for s in sizes:
        out.append(v[at:at + int(np.prod(s))].reshape(s))
        at += int(np.prod(s))
    return out


def length(width: int, hidden: int, classes: int) -> int:
    return width * hidden + hidden + hidden * classes + classes if hidden else width * classes + classes


def outputs(x: np.ndarray, parts: list[np.ndarray], held: np.ndarray | None = None) -> tuple[np.ndarray | None, np.ndarray]:
    """(hidden values, class probabilities) of the columns of ``x``; ``held``: an array for the hidden values."""
    h = None
    if len(parts) == 4:
        h = np.matmul(parts[0].T, x, out=held)
        h += parts[1][:, None]
        np.maximum(h, 0.0, out=h)
    return h, shares(parts[-2].T @ (x if h is None else h) + parts[-1][:, None], 0)


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, v: np.ndarray, hidden: int, classes: int) -> np.ndarray:
    """Summed weighted cross-entropy of the columns of ``x`` and, after it, its gradient in ``v``."""
    parts, total = layers(v, len(x), hidden, classes), np.zeros(1 + len(v))
    sums = layers(total[1:], len(x), hidden, classes)
    held = back = np.empty((0, 0))
    for lo in range(0, len(y), CHUNK):
        some, own, weight = x[:, lo:lo + CHUNK].astype(np.float64), y[lo:lo + CHUNK], w[lo:lo + CHUNK]
        if hidden and held.shape[1] != len(own):  # memory is asked for once, not by every chunk
            held, back, on = np.empty((hidden, len(own))), np.empty((hidden, len(own))), np.empty((hidden, len(own)), bool)
        h, p = outputs(some, parts, held if hidden else None)
        error = p * weight
        for c in range(classes):
            here = weight * (own == c)
            total[0] -= here @ np.log(np.maximum(p[c], 1e-300))
            error[c] -= here
        sums[-2] += (some if h is None else h) @ error.T
        sums[-1] += error.sum(1)
        if h is not None:
            np.matmul(parts[2], error, out=back)
            np.multiply(back, np.greater(h, 0, out=on), out=back)
            sums[0] += some @ back.T
            sums[1] += back.sum(1)
    return total


class Descent:
    """Steps of one model: proposes a point, is told the loss and gradient there."""

    def __init__(self, start: np.ndarray, steps: int, tolerance: float):
        self.point, self.steps, self.tolerance = start, steps, tolerance
        self.proposed, self.loss, self.gradient, self.done, self.taken = start, np.inf, None, False, 0
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.best, self.idle = np.inf, 0
        self.rate, self.direction = 1.0, np.zeros_like(start)

    def aim(self) -> None:
        d, kept = self.gradient.copy(), []
        for s, y in reversed(self.pairs):
            a = s @ d / (s @ y)
            kept.append(a)
            d -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            d *= s @ y / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(kept)):
            d += (a - y @ d / (s @ y)) * s
        self.direction = -d
        self.rate = 1.0 if self.pairs else 1.0 / max(1.0, np.linalg.norm(d))
        self.proposed = self.point + self.rate * self.direction

    def told(self, loss: float, gradient: np.ndarray) -> None:
        if self.gradient is not None and not loss <= self.loss + 1e-4 * self.rate * (self.gradient @ self.direction):
            self.rate /= 2  # too far: back along the same direction
            self.done = self.rate < 1e-12
            self.proposed = self.point + self.rate * self.direction
            return
        if self.gradient is not None:
            s, y = self.proposed - self.point, gradient - self.gradient
            if s @ y > 1e-12 * (y @ y):
                self.pairs = [*self.pairs[1 - MEMORY:], (s, y)]
            self.taken += 1
        self.point, self.loss, self.gradient = self.proposed, loss, gradient
        self.idle = self.idle + 1 if loss > self.best - self.tolerance else 0
        self.best = min(self.best, loss)
        self.done = self.taken >= self.steps or np.abs(gradient).max() <= self.tolerance or self.idle > PATIENCE
        if not self.done:
            self.aim()


def start(width: int, hidden: int, classes: int, seed: int) -> np.ndarray:
    """Zeros for the linear model, else uniform weights in the bounds of the layers' sizes."""
    v = np.zeros(length(width, hidden, classes))
    if hidden:
        rng = np.random.default_rng(seed)
        for part, sizes in zip(layers(v, width, hidden, classes), ((width, hidden), (width, hidden), (hidden, classes), (hidden, classes))):
            part[...] = rng.uniform(-1, 1, part.shape) * np.sqrt(6.0 / sum(sizes))
    return v


def fit(rows: RDD, models: int, width: int, hidden: int, classes: int, ridge: float, steps: int, tolerance: float = 1e-4, seed: int = 42) -> Net:
    """Weights of every model after at most ``steps`` steps, or as soon as no part of the gradient
    exceeds ``tolerance`` or more than ``PATIENCE`` steps running lower the loss by less than it."""
    size = length(width, hidden, classes)
    rows.unpersist()  # the columns are kept in place of the rows
    rows = rows.map(lambda b: replace(b, x=[Column(c) for c in b.x.T], y=Column(b.y), w=Column(b.w), row=None)).persist(StorageLevel.MEMORY_AND_DISK)

    def weigh(out: np.ndarray, b: Block) -> None:
        out[b.model, 0] += b.w.read().sum()

    total = np.maximum(summed(rows, (models, 1), weigh)[:, 0], 1e-300)
    penalised = np.concatenate([np.full(p.size, float(p.ndim == 2)) for p in layers(np.zeros(size), width, hidden, classes)])
    paths = [Descent(start(width, hidden, classes, seed), steps, tolerance) for _ in range(models)]
    while not all(p.done for p in paths):
        points = {m: p.proposed for m, p in enumerate(paths) if not p.done}

        def add(out: np.ndarray, b: Block, points=points) -> None:
            if b.model in points:
                x = np.stack([c.read() for c in b.x]) if b.x else np.zeros((0, len(b.y.values)), np.float32)
                out[b.model] += loss_and_gradient(x, b.y.read(), b.w.read(), points[b.model], hidden, classes)

        sums = summed(rows, (models, 1 + size), add)
        for m, v in points.items():
            weights = v * penalised
            paths[m].told((sums[m, 0] + 0.5 * ridge * (weights @ weights)) / total[m], (sums[m, 1:] + ridge * weights) / total[m])
    rows.unpersist()
    return Net(width, hidden, classes, np.stack([p.point for p in paths]))


def probabilities(x: np.ndarray, model: int, net: Net) -> np.ndarray:
    return outputs(x.T.astype(np.float64), layers(net.weights[model], net.width, net.hidden, net.classes))[1].T
