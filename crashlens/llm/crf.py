"""A linear-chain conditional random field over word shapes, in numpy.

Training maximises the penalised log-likelihood of a small labelled table by full
batches (forward-backward over all sequences at once); decoding is Viterbi over
batches of sequences of one length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

_RUN = re.compile(r"X+|x+|0+")
_DIGIT_STEPS = (0, 1, 3, 5, 8, 10, 14, 20)
_LENGTH_STEPS = (0, 4, 8, 12, 16, 24, 32, 48)
_TURN_STEPS = (0, 1, 2, 3, 5, 8, 12)
_TURN = re.compile(r"(?<=[Xx])(?=0)|(?<=0)(?=[Xx])")


def shape(word: str) -> str:
    """Letters as X or x, digits as 0, other characters as they are (so a shape is its own shape)."""
    return "".join("0" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)


def word_features(word: str) -> list[str]:
    """Names of the features of a word; they see its shape only."""
    s = shape(word.rstrip(".,;:!?"))
    short = _RUN.sub(lambda m: m[0][0], s)
    digits = s.count("0")
    step = sum(digits >= x for x in _DIGIT_STEPS)
    sized = _RUN.sub(lambda m: m[0][0] + str(len(m[0])) if m[0][0] == "0" else m[0][0], s)
    length = sum(len(s) >= x for x in _LENGTH_STEPS)
    turns = sum(len(_TURN.findall(s)) >= x for x in _TURN_STEPS)  # from letters to digits and back
    return ["word", f"length={length}", f"turns={turns}", f"short={short}", f"sized={sized}", f"digits={step}", f"first={s[:1]}", f"last={s[-1:]}", f"at={'@' in s}", f"only={set(s) == {'0'}}"]


@dataclass
class Crf:
    """``move`` has a last row for the start and a last column for the end."""

    labels: list[str]
    index: dict[str, int]
    emit: np.ndarray  # feature x label
    move: np.ndarray  # (label + start) x (label + end)

    def emission(self, word: str) -> np.ndarray:
        at = [self.index[f] for f in word_features(word) if f in self.index]
        return self.emit[at].sum(axis=0)


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.asarray([len(s) for s in sequences])
    out = np.full((len(sequences), size.max(), *sequences[0].shape[1:]), -1, sequences[0].dtype)
    for i, s in enumerate(sequences):
        out[i, : len(s)] = s
    return out, size


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(rows: list[tuple[list[str], list[str]]], labels: list[str], ridge: float = 0.002, steps: int = 200) -> Crf:
    """``rows``: (words, labels) of each sequence."""
    rows = [r for r in rows if r[0]]
    names = sorted({f for words, _ in rows for w in set(words) for f in word_features(w)})
    index = {f: i for i, f in enumerate(names)}
    width, kinds = len(names), {k: i for i, k in enumerate(labels)}
    L = len(labels)
    emit, move = np.zeros((width + 1, L)), np.zeros((L + 1, L + 1))
    if not rows:
        return Crf(labels, index, emit[:-1], move)
    slots = max(len(word_features(w)) for words, _ in rows for w in words)
    known = {w: np.asarray([index[f] for f in word_features(w)] + [width] * (slots - len(word_features(w)))) for words, _ in rows for w in words}
    feats, size = _padded([np.stack([known[w] for w in words]) for words, _ in rows])
    gold, _ = _padded([np.asarray([kinds[k] for k in ks]) for _, ks in rows])
    n, T = gold.shape
    here = np.arange(T)[None, :] < size[:, None]
    feats[~here] = width
    # what the labelled table itself counts
    want_emit, want_move = np.zeros_like(emit), np.zeros_like(move)
    i, t = np.nonzero(here)
    for k in range(slots):
        np.add.at(want_emit, (feats[i, t, k], gold[i, t]), 1)
    np.add.at(want_move, (np.full(n, L), gold[:, 0]), 1)
    np.add.at(want_move, (gold[np.arange(n), size - 1], np.full(n, L)), 1)
    i, t = np.nonzero(here[:, 1:])
    np.add.at(want_move, (gold[i, t], gold[i, t + 1]), 1)
    m = [np.zeros_like(emit), np.zeros_like(move)]
    v = [np.zeros_like(emit), np.zeros_like(move)]
    for step in range(1, steps + 1):
        e = emit[feats].sum(axis=2)
        a, b = np.empty((n, T, L)), np.empty((n, T, L))
        a[:, 0] = move[L, :L] + e[:, 0]
        for t in range(1, T):
            a[:, t] = np.where(here[:, t, None], _logsum(a[:, t - 1, :, None] + move[None, :L, :L], 1) + e[:, t], a[:, t - 1])
        z = _logsum(a[:, -1] + move[:L, L], 1)
        b[:, T - 1] = move[:L, L]
        for t in range(T - 2, -1, -1):
            b[:, t] = np.where(here[:, t + 1, None], _logsum(move[None, :L, :L] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), move[:L, L])
        p = np.where(here[..., None], np.exp(a + b - z[:, None, None]), 0)
        have_emit, have_move = np.zeros_like(emit), np.zeros_like(move)
        for k in range(slots):
            np.add.at(have_emit, feats[:, :, k], p)
        have_move[L, :L] = p[:, 0].sum(0)
        have_move[:L, L] = p[np.arange(n), size - 1].sum(0)
        for t in range(T - 1):
            both = np.exp(a[:, t, :, None] + move[None, :L, :L] + (e[:, t + 1] + b[:, t + 1])[:, None, :] - z[:, None, None])
            have_move[:L, :L] += both[here[:, t + 1]].sum(0)
        for x, grad, mm, vv in ((emit, (want_emit - have_emit) / n - ridge * emit / 10, m[0], v[0]), (move, (want_move - have_move) / n - ridge * move / 10, m[1], v[1])):
            mm *= 0.9
            mm += 0.1 * grad
            vv *= 0.99
            vv += 0.01 * grad * grad
            x += 0.1 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
        emit[width] = 0
    return Crf(labels, index, emit[:-1], move)


def decode(model: Crf, sequences: list[np.ndarray], before: list[int], after: list[int]) -> list[np.ndarray]:
    """Best labels of each sequence of emissions; ``before`` and ``after`` are the label
    next to it, or ``len(labels)`` at the start or end of the text."""
    out: list = [None] * len(sequences)
    by_size = defaultdict(list)
    for i, s in enumerate(sequences):
        by_size[len(s)].append(i)
    L = len(model.labels)
    for size, members in by_size.items():
        for lo in range(0, len(members), 2048):
            some = members[lo : lo + 2048]
            e = np.stack([sequences[i] for i in some])
            best = model.move[[before[i] for i in some], :L] + e[:, 0]
            back = np.zeros((len(some), size, L), np.int8)
            for t in range(1, size):
                step = best[:, :, None] + model.move[None, :L, :L]
                back[:, t] = step.argmax(1)
                best = step.max(1) + e[:, t]
            last = (best + model.move[:L, [after[i] for i in some]].T).argmax(1)
            path = np.empty((len(some), size), np.int64)
            for t in range(size - 1, -1, -1):
                path[:, t] = last
                last = back[np.arange(len(some)), t, last]
            for i, p in zip(some, path):
                out[i] = p
    return out
