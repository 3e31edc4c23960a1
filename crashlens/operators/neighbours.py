"""Exact nearest neighbours inside classes, by boxes.

A class is cut into cells by planes that a bounded sample of its rows suggests (any planes
give the same result), a cell of many rows into blocks by a hash of the id.  A task searches
a block by itself: a tree of leaves with the least and greatest value of each feature, of
which only those that can hold a nearer row are looked at.  A row's k-th distance in its own
block bounds that of its true neighbours, so it asks another block only if the box around
that block's rows is no farther.  Rows that ask a block come to it in slices of a
block's size, so a task holds two blocks, however large a class or a cell is.
Distances are squared sums of differences; ties go to the smaller id.  Most pairs are
told apart by a matrix product with a bound on its rounding; only those that it leaves
within the limit get their distance, feature by feature.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.session import discard, stored

#: Cells of a class at most, rows of a block, rows of the sample for each cell.
CELLS = 256
BLOCK = 32_768
SAMPLE = 64
#: Rows of a leaf, rows whose distances bound those of a leaf's rows first.
LEAF = 256
FIRST = 1024
NEAR = "array<struct<d: double, id: string, x: array<double>>>"
ENTRY = pa.struct([("d", pa.float64()), ("id", pa.string()), ("x", pa.list_(pa.float64()))])


def vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    chunks = [c.flatten() for c in column.chunks]
    return np.asarray(pa.concat_arrays(chunks) if chunks else pa.array([], pa.float64()), dtype=np.float64).reshape(-1, width)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to those of ``b``, feature by feature."""
    out = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        out += np.square(a[:, f, None] - b[None, :, f])
    return out


def products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of all rows by a matrix product, and how far any of them may be off."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b))), 0.0
    told = b[np.isfinite(b).all(1)]  # a row with NaN is near no row
    middle = told.mean(0) if len(told) else np.zeros(b.shape[1])
    a, b = a - middle, b - middle
    of_a, of_b = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    most = sum(v[np.isfinite(v)].max(initial=0.0) for v in (of_a, of_b))
    return of_a[:, None] + of_b[None, :] - 2.0 * (a @ b.T), 1e-13 * (most + np.square(middle).sum())


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs of rows, added up as in :func:`squares`."""
    out = np.zeros(len(a))
    for f in range(a.shape[1]):
        out += np.square(a[:, f] - b[:, f])
    return out


def from_boxes(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """At most the squared distance of each row of ``a`` to any row inside each box."""
    out = np.zeros((len(a), len(low)))
    for f in range(a.shape[1]):
        out += np.square(np.maximum(np.maximum(low[None, :, f] - a[:, f, None], a[:, f, None] - high[None, :, f]), 0.0))
    return out * (1 - 1e-9)


def apart(least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """At most the squared distance of any row between ``least`` and ``most`` to any row of each box."""
    return np.square(np.maximum(np.maximum(low - most, least - high), 0.0)).sum(1) * (1 - 1e-9)


def plane(x: np.ndarray) -> tuple[int, float] | None:
    """(feature, value) whose rows up to the value differ most from the others, of two halves
    as even as the feature allows; None where all rows are equal."""
    best, found, n = 0.0, None, len(x)
    for f in range(x.shape[1]):
        v = np.sort(x[:, f])
        if v[0] == v[-1]:
            continue
        middle = v[n // 2]
        for cut in (int(np.searchsorted(v, middle, "left")), int(np.searchsorted(v, middle, "right"))):
            if 0 < cut < n:
                worth = cut * (n - cut) / (n * n) * np.square(v[cut:].mean() - v[:cut].mean())
                if worth > best or found is None:
                    best, found = worth, (f, float(v[cut - 1]))
    return found


@dataclass
class Planes:
    """A tree of planes: feature (-1: a cell), value (at most goes left) and, of an inner node, the left
    child (the right one follows) or, of a cell, its number."""

    feature: np.ndarray
    value: np.ndarray
    to: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            here = node[rows]
            inner = self.feature[here] >= 0
            rows, here = rows[inner], here[inner]
            node[rows] = self.to[here] + (x[rows, self.feature[here]] > self.value[here])
        return self.to[node]


def planes(x: np.ndarray, cells: int = 0, leaf: int = 0) -> tuple[Planes, list[np.ndarray]]:
    """About ``cells`` cells of like numbers of rows, or cells of at most ``leaf`` rows (more where rows are
    equal), and the rows of each."""
    feature, value, to, members = [-1], [0.0], [0], []
    open_ = [(0, np.arange(len(x)), cells)]
    while open_:
        node, rows, n = open_.pop()
        cut = plane(x[rows]) if len(rows) > 1 and (n > 1 or (leaf and len(rows) > leaf)) else None
        if cut is None:
            to[node] = len(members)
            members.append(rows)
            continue
        right = x[rows, cut[0]] > cut[1]
        feature[node], value[node], to[node] = cut[0], cut[1], len(feature)
        share = min(max(round(n * (1 - right.mean())), 1), max(n - 1, 1))
        for part, m in ((rows[~right], share), (rows[right], n - share)):
            open_.append((len(feature), part, m))
            feature.append(-1)
            value.append(0.0)
            to.append(0)
    return Planes(np.array(feature), np.array(value), np.array(to)), members


def among(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, limits: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, distance) of the k nearest rows of ``b`` within the limit of each row of
    ``a``, by row, distance and id; ``own``: the same rows in both, none is near itself."""
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    # of equal rows only the first k + 1 by id can be among the k nearest of any row
    _, same = np.unique(np.ascontiguousarray(b).view(f"V{b.itemsize * b.shape[1]}").ravel(), return_inverse=True) if b.size else (None, np.zeros(len(b), np.int64))
    by = np.lexsort((rank, same))
    first = np.flatnonzero(np.r_[True, same[by][1:] != same[by][:-1]]) if len(by) else by
    at = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
    kept = np.sort(by[at <= k])
    tree, members = planes(b[kept], leaf=LEAF)
    members = [kept[m] for m in members]
    low, high = (np.stack([end(b[m], axis=0) for m in members]) for end in (np.min, np.max))
    home = tree.cells(a)
    order = np.argsort(home, kind="stable")
    ends = np.searchsorted(home[order], np.arange(len(members) + 1))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for leaf in range(len(members)):
        for lo in range(ends[leaf], ends[leaf + 1], LEAF):
            rows = order[lo:min(lo + LEAF, ends[leaf + 1])]
            some, limit = a[rows], limits[rows].copy()
            # leaves from the nearest to the box of these rows
            far = apart(some.min(0), some.max(0), low, high)
            near = np.argsort(far, kind="stable")
            size = np.cumsum([len(members[m]) for m in near])
            head = near[:1 + int(np.searchsorted(size, FIRST))]
            there = np.concatenate([members[m] for m in head])
            d, off = products(some, b[there])
            if own:
                d[rows[:, None] == there[None, :]] = np.inf
            if len(there) > k:
                limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1].clip(0) + off)  # at least the k-th distance
            found = [(*np.nonzero(d <= limit[:, None] + off), there)]
            rest = near[len(head):]
            rest = rest[far[rest] <= limit.max(initial=-np.inf)]
            reach = from_boxes(some, low[rest], high[rest]) <= limit[:, None]
            for p in np.flatnonzero(reach.any(0)):
                asking, there = np.flatnonzero(reach[:, p]), members[rest[p]]
                d, off = products(some[asking], b[there])
                i, j = np.nonzero(d <= limit[asking, None] + off)
                found.append((asking[i], j, there))
            i, j = np.concatenate([f[0] for f in found]), np.concatenate([t[js] for _, js, t in found])
            d = exact(some[i], b[j])
            within = (d <= limits[rows][i]) & (d < np.inf)
            if own:
                within &= rows[i] != j
            i, j, d = i[within], j[within], d[within]
            best = np.lexsort((rank[j], d, i))
            i, j, d = i[best], j[best], d[best]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            out.append((rows[i[place < k]], j[place < k], d[place < k]))
    i, j, d = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    by = np.argsort(i, kind="stable")
    return i[by], j[by], d[by]


def entries(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, b: np.ndarray, ids: pa.Array) -> pa.Array:
    """The pairs of :func:`among` as a list per row."""
    starts = np.searchsorted(i, np.arange(n + 1)).astype(np.int32)
    x = pa.ListArray.from_arrays(pa.array(np.arange(len(j) + 1, dtype=np.int32) * b.shape[1]), pa.array(b[j].ravel()))
    return pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([pa.array(d.astype(float)), ids.take(pa.array(j)), x], fields=list(ENTRY)))


def one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def nearest(df: DataFrame, features: Sequence[str], id_col: str, k: int, seed: int, label: str, block: int = BLOCK, most: int = CELLS) -> DataFrame:
    """``id_col``, ``near``: the k nearest other rows of the same class as an array of (d, id, x).

    ``block``: rows of a block, about (a cell with more than twice as many is cut); ``most``: cells of a class."""
    spark, width = df.sparkSession, len(features)
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("x")
    every = df.select(F.col(id_col).cast("string").alias("id"), F.col(label).cast("long").alias("class"), x)
    # a row with a missing or infinite value is near no row
    rows = stored(every.where(F.forall("x", lambda v: F.abs(v) < float("inf"))), "neighbours")
    sizes = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return rows.select(F.col("id").alias(id_col), F.lit(None).cast(NEAR).alias("near"))
    number = {c: min(most, -(-n // block)) for c, n in sizes.items()}
    one_of = spark.createDataFrame([(c, max(1, sizes[c] // (SAMPLE * n))) for c, n in number.items() if n > 1] or [(0, 1)], "of long, one_of long")
    drawn = rows.join(F.broadcast(one_of), F.col("class") == F.col("of")).where(F.pmod(F.xxhash64("id", "x", F.lit(seed)), "one_of") == 0)
    sample = drawn.select("class", "x").collect() if max(number.values()) > 1 else []  # SAMPLE rows a cell, about
    cut = {c: planes(np.array(sorted(r["x"] for r in sample if r["class"] == c)).reshape(-1, width), n)[0] for c, n in number.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, values = np.asarray(batch.column("class")), vectors(pa.chunked_array([batch.column("x")]), width)
            cell = np.zeros(len(classes), np.int32)
            for c in np.unique(classes).tolist():
                at = np.flatnonzero(classes == c)
                cell[at] = cut[c].cells(values[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    dealt = stored(rows.mapInArrow(assign, "id string, class long, x array<double>, cell int"), "neighbour-cells")
    discard(rows)
    ends = [end(F.get("x", F.lit(f))).alias(f"{name}{f}") for name, end in (("low", F.min), ("high", F.max)) for f in range(width)]
    cells = sorted(dealt.groupBy("class", "cell").agg(F.count(F.lit(1)).alias("n"), *ends).collect(), key=lambda r: r[:2])  # ``most`` a class
    parts = [-(-r["n"] // (2 * block)) for r in cells]
    first = np.cumsum([0, *parts])
    low, high = (np.array([[r[f"{name}{f}"] for f in range(width)] for r in cells], float).reshape(-1, width) for name in ("low", "high"))
    class_of, cell_of = np.array([r["class"] for r in cells]), np.repeat(np.arange(len(cells)), parts)
    numbered = spark.createDataFrame([(r["class"], r["cell"], int(f), p) for r, f, p in zip(cells, first, parts)], "class long, cell int, first int, parts int")
    at = (F.col("first") + F.pmod(F.xxhash64("id", F.lit(seed)), "parts")).cast("int")
    blocks = dealt.join(F.broadcast(numbered), ["class", "cell"]).select("id", "x", at.alias("block"))

    def spread(groups: int) -> int:
        return max(spark.sparkContext.defaultParallelism, 2 * groups)

    def home(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        mine = key[0].as_py()
        values, ids = vectors(table["x"], width), one(table["id"])
        i, j, d = among(values, values, ids.to_numpy(zero_copy_only=False), k, np.full(len(values), np.inf), True)
        limits = np.full(len(values), np.inf)
        last = np.searchsorted(i, np.arange(len(values)), "right") - 1
        full = np.bincount(i, minlength=len(values)) == k
        limits[full] = d[last[full]]
        others = np.flatnonzero(class_of == class_of[cell_of[mine]])
        asks = []
        for lo in range(0, len(values), LEAF):
            reach = from_boxes(values[lo:lo + LEAF], low[others], high[others]) <= limits[lo:lo + LEAF, None]
            asks += [[b for c in others[r].tolist() for b in range(first[c], first[c + 1]) if b != mine] for r in reach]
        return pa.table({"id": ids, "x": table["x"], "near": entries(len(values), i, j, d, values, ids), "limit": pa.array(limits), "asks": pa.array(asks, pa.list_(pa.int32()))})

    whole = blocks.repartition(spread(int(first[-1])), "block").groupBy("block")
    bounded = stored(whole.applyInArrow(home, f"id string, x array<double>, near {NEAR}, limit double, asks array<int>"), "neighbour-bounds")
    asks = bounded.select(F.col("id"), F.col("x"), F.col("limit"), F.explode("asks").alias("to"))
    asked = [(r["to"], -(-r["n"] // (2 * block))) for r in asks.groupBy("to").agg(F.count(F.lit(1)).alias("n")).collect()]  # one row per block
    found = bounded.select("id", "near")
    if asked:
        slices = F.broadcast(spark.createDataFrame(asked, "to int, slices int"))
        asks = asks.join(slices, "to").withColumn("slice", F.pmod(F.xxhash64("id", F.lit(seed + 1)), "slices").cast("int"))
        there = blocks.join(slices.withColumnRenamed("to", "block"), "block").select(
            "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("part"), F.col("id").alias("c_id"), F.col("x").alias("c_x"))

        def meet(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
            a, b, ids = vectors(left["x"], width), vectors(right["c_x"], width), one(right["c_id"])
            i, j, d = among(a, b, ids.to_numpy(zero_copy_only=False), k, np.asarray(left["limit"]), False)
            rows, i = np.unique(i, return_inverse=True)
            return pa.table({"id": one(left["id"]).take(pa.array(rows)), "near": entries(len(rows), i, j, d, b, ids)})

        n = spread(sum(s for _, s in asked))
        pairs = asks.drop("slices").repartition(n, "to", "slice").groupBy("to", "slice").cogroup(there.repartition(n, "block", "part").groupBy("block", "part"))
        found = found.unionByName(pairs.applyInArrow(meet, f"id string, near {NEAR}"))
    else:
        discard(dealt)
    best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    return found.where(F.size("near") > 0).groupBy("id").agg(best.alias("near")).withColumnRenamed("id", id_col)
