"""Periodic runs of words: found by recursive frequency splitting and a scan of lags.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) of at least ``least`` words and two periods that no neighbour extends.
Each of its words occurs twice in it or more.  So words that occur once in their
segment (a document at first) can't be in a run: they split the segment, which
makes further words rare, until nothing changes; segments below ``least`` words go.
All segments of a batch are split together.

What survives is scanned for lags.  A run repeats itself at lag q over q words or
more, so for lags from 2^k to below 2^(k+1) it holds an aligned block of half of 2^k
words that occurs again at that lag.  Equal windows of each power of two get equal
numbers; the blocks' later occurrences within reach are looked up in the sorted
numbers and extended to both sides by whole windows.  Comparisons are exact and the
work is about n log^2 n for a text of n words, however it repeats itself.

Documents are independent: one pass over the input, no shuffle, and a task holds
one Arrow batch of ``slices`` (a longer text alone).

Edge cases: a null text has no word, no run and an empty collapsed text, as the
empty text; a null id is passed on; repeated rows are found each; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crashlens.llm.common import as_batch, plain, slices

LEAST = 12


def surviving(words: np.ndarray, docs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(places, segment of each place) of the words that can be in a run.  ``words`` numbers
    the words of all documents, ``docs`` (ascending) tells whose each is."""
    at, segment = np.arange(len(words)), docs
    while len(at):
        before = len(at)
        size = np.bincount(segment)
        stays = size[segment] >= least
        at, segment = at[stays], segment[stays]
        pair = segment * np.int64(words.max() + 1) + words[at]
        _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        stays = count[which] > 1
        at, segment = at[stays], segment[stays]
        if len(at) == before:
            break
        first = np.ones(len(at), bool)  # a gap or another old segment starts a segment
        first[1:] = (np.diff(at) != 1) | (np.diff(segment) != 0)
        segment = np.cumsum(first) - 1
    return at, segment


def windows(x: np.ndarray) -> list[np.ndarray]:
    """For each power of two up to the length: equal numbers for equal windows, by start."""
    out, size = [np.unique(x, return_inverse=True)[1].astype(np.int64)], 1
    while size * 2 <= len(x):
        a = out[-1]
        pair = a[:-size] * np.int64(len(x) + 1) + a[size:]
        out.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        size *= 2
    return out


def extended(tables: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, stop) in terms of ``i`` of the stretches around the equal places (i, j), i < j,
    in which the words at both lag alike."""
    n = len(tables[0])
    left, right = i.copy(), i.copy()
    lag = j - i
    for power in range(len(tables) - 1, -1, -1):
        table, size = tables[power], 1 << power
        fits = right + lag + size <= n
        same = np.zeros(len(i), bool)
        same[fits] = table[right[fits]] == table[(right + lag)[fits]]
        right[same] += size
        fits = left >= size
        same = np.zeros(len(i), bool)
        same[fits] = table[left[fits] - size] == table[(left + lag)[fits] - size]
        left[same] -= size
    return left, right


def lags(x: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``x``, by start and period."""
    n = len(x)
    tables, found = windows(x), []
    cover = np.zeros(n, np.int64)  # of the run that reaches furthest from each place: stop and period
    low = 1
    while 2 * low <= n:
        power = max(0, low.bit_length() - 2)  # blocks of half of ``low`` words, one at least
        table, size = tables[power], 1 << power
        order = np.argsort(table, kind="stable")
        keys = table[order] * np.int64(n + 1) + order
        block = np.arange(0, len(table), size)
        base = table[block] * np.int64(n + 1)
        # no further than the number's own entries
        lo = np.searchsorted(keys, base + np.minimum(block + low, n))
        hi = np.searchsorted(keys, base + np.minimum(block + 2 * low, n))
        many = hi - lo
        i = np.repeat(block, many)
        j = order[np.repeat(lo, many) + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)]
        stop, period = cover[i] // (n + 1), n - cover[i] % (n + 1)
        news = (stop < j + size) | ((j - i) % period > 0)  # others repeat a known run's period
        i, j = i[news], j[news]
        if len(i):
            first, stop = extended(tables, i, j)
            lag = j - i
            length = stop - first + lag
            good = length >= np.maximum(least, 2 * lag)
            found.append(np.unique(np.stack([first[good], length[good], lag[good]], 1), axis=0))
            start, length, period = found[-1].T
            np.maximum.at(cover, start, (start + length) * (n + 1) + n - period)
            cover = np.maximum.accumulate(cover)
        low *= 2
    if not found:
        return []
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    new = np.ones(len(every), bool)  # of equal stretches the smallest period stays
    new[1:] = (np.diff(every[:, 0]) != 0) | (np.diff(every[:, 1]) != 0)
    every = every[new]
    return [tuple(r) for r in every[np.lexsort((every[:, 2], every[:, 0]))].tolist()]


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    known: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at, segment = surviving(words, np.repeat(np.arange(len(texts)), sizes), least)
    for part in np.split(at, np.flatnonzero(np.diff(segment)) + 1) if len(at) else []:
        doc = int(np.searchsorted(starts, part[0], "right")) - 1
        shift = int(part[0] - starts[doc])
        out[doc] += [(s + shift, length, q) for s, length, q in lags(words[part], least)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run contains after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period; by start and
    period), text (the kept words, joined by one space)."""
    source = plain(docs)
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            found = runs_of(texts, least)
            out = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("text", pa.string())])
            kept = pa.array([collapsed(t, r) for t, r in zip(texts, found)], pa.binary()).cast(pa.string())
            rows = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found], pa.list_(run))
            yield as_batch(out, batch.column("doc_id"), list(map(len, texts)), rows, kept)

    return source.mapInArrow(find, schema)
