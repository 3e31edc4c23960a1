"""M5: random forest without a depth limit.

Every tree sees a row as often as a hash of the row and the tree says (a bootstrap by
Poisson counts).  Growth starts with passes over all blocks: nodes that hold more
rows than fit a task are split by class counts per (tree, node, feature, bin), for the
random features of the node.  The rows of a node that fits are then sent to one task,
which finishes its subtree with exact thresholds until every leaf is pure or cannot be
split.  Subtrees are rows of a table; they never meet on the driver, which holds the
split large nodes alone.  Predictions join bundles of trees with blocks of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.operators.blocks import Block, coded, summed
from crashlens.operators.boosting import binned
from crashlens.session import stored

#: Bootstrap rows of a node that one task finishes.
ROWS = 400_000
#: Trees that are applied together to a block of rows.
BUNDLE = 10
SUBTREE = "model int, tree int, node long, n int, feature binary, threshold binary, share binary"


@dataclass
class Forest:
    """``top``: per (model, tree) the split large nodes, node -> (feature, threshold), with children
    2 * node and 2 * node + 1 of the root 1; ``subtrees``: the finished rest."""

    trees: int
    classes: int
    top: dict[tuple[int, int], dict[int, tuple[int, float]]] = field(default_factory=dict)
    subtrees: DataFrame | None = None


def mixed(x: np.ndarray) -> np.ndarray:
    """A scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(*keys: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the keys alone."""
    h = np.zeros(1, np.uint64)
    for k in keys:
        k = np.asarray(k, np.int64).view(np.uint64) if isinstance(k, np.ndarray) else np.uint64(k)
        h = mixed(h + k + np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


#: Distribution function of the Poisson counts with mean 1.
POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, i + 1)) for i in range(20)])


def times(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's bootstrap draws each row."""
    return np.searchsorted(POISSON, uniform(row, tree + 1, seed), side="right")


def ordered(tree: int, node: int, width: int, seed: int) -> np.ndarray:
    """The features in the order in which a large node tries them."""
    return np.argsort(uniform(np.arange(width), tree + 1, node, seed), kind="stable")


def placed(x: np.ndarray, top: dict[int, tuple[int, float]]) -> np.ndarray:
    """Number of the node below the split large nodes that each row reaches."""
    node = np.ones(len(x), np.int64)
    for at in sorted(top):
        feature, threshold = top[at]
        here = np.flatnonzero(node == at)
        node[here] = 2 * at + (x[here, feature] > threshold)
    return node


def told(levels: np.ndarray, codes: np.ndarray) -> bytes:
    """A column's values of some rows: levels and numbers, or the values where these take fewer bytes."""
    if levels.nbytes + codes.nbytes < len(codes) * levels.itemsize:
        return np.int32(len(levels)).tobytes() + levels.tobytes() + codes.tobytes()
    return np.int32(0).tobytes() + levels[codes].tobytes()


def heard(data: bytes, n: int, kinds: list[type]) -> list[np.ndarray]:
    """The columns, of these types and ``n`` rows each, that :func:`told` wrote one after the other."""
    out, at = [], 0
    for kind in map(np.dtype, kinds):
        known = int(np.frombuffer(data, np.int32, 1, at)[0])
        values = np.frombuffer(data, kind, known or n, at + 4)
        at += 4 + values.nbytes
        if known:
            codes = np.frombuffer(data, np.min_scalar_type(known - 1), n, at)
            values, at = values[codes], at + codes.nbytes
        out.append(values)
    return out


def tasks(spark, groups: int) -> int:
    """Partitions for so many groups of like work."""
    return max(spark.sparkContext.defaultParallelism, groups // 4)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, tries: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """A full tree over the rows, level by level: feature (-1: leaf), threshold (at most goes left),
    child (the left one; the right one follows) and share of each class.

    A node tries features in random order until ``tries`` of them vary and takes the split with
    the least impurity."""
    width = x.shape[1]
    levels = [np.unique(x[:, f], return_inverse=True) for f in range(width)]
    big = max([1, *(len(v) for v, _ in levels)])
    bits = np.int64(int(big - 1).bit_length())  # a node and a value make one number
    codes = np.stack([c for _, c in levels], 1).astype(np.min_scalar_type(big)).ravel() if width else np.zeros(0, np.uint8)  # row by row
    label, w = y.astype(np.min_scalar_type(classes)), np.asarray(w, np.float64)
    rows, node, count = np.arange(len(y)), np.zeros(len(y), np.int64), 1  # of the level's open nodes
    out: list[dict[str, np.ndarray]] = []
    base = 0  # number of the level's first node
    while count:
        of, weighed = label.take(rows), w.take(rows)
        share = np.stack([np.bincount(node, np.where(of == c, weighed, 0.0), count) for c in range(classes)])
        total = share.sum(0)
        feature, code, best = np.full(count, -1), np.zeros(count, np.int64), np.full(count, -np.inf)
        order = np.ascontiguousarray(np.argsort(rng.random((count, width)), axis=1).T)
        tried, open_ = np.zeros(count, np.int64), (share > 0).sum(0) > 1
        held = open_.take(node)  # rows whose node tries another feature
        row, own = rows[held], node[held]
        for slot in range(width):
            if slot >= tries:
                more = (tried < tries).take(own)
                if not more.all():
                    row, own = row[more], own[more]
            if not len(row):
                break
            key = codes.take(row * width + order[slot].take(own)) + (own << bits)
            by = np.argsort(key)
            key = key.take(by)
            differ = key[1:] ^ key[:-1]
            steps = np.flatnonzero(differ)
            inside = (differ.take(steps) >> bits) == 0
            edge, ends = steps[inside], steps[~inside]  # a split after these; the last rows of nodes
            if not len(edge):
                continue
            here, after, row_by = key.take(edge) >> bits, key.take(ends + 1) >> bits, row.take(by)
            class_by, weight_by = label.take(row_by), w.take(row_by)
            left_all, right_all, left_square, right_square = np.zeros((4, len(edge)))
            for c in range(classes):
                cum = np.cumsum(np.where(class_by == c, weight_by, 0.0))
                before = np.zeros(count)
                before[after] = cum.take(ends)
                left = cum.take(edge) - before.take(here)
                right = share[c].take(here) - left
                left_all += left
                right_all += right
                left_square += left * left
                right_square += right * right
            worth = left_square / np.maximum(left_all, 1e-300) + right_square / np.maximum(right_all, 1e-300)
            start = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            nodes = here[start]
            tried[nodes] += 1
            top = np.maximum.reduceat(worth, start)
            is_top = np.flatnonzero(worth == np.repeat(top, np.diff(np.r_[start, len(here)])))
            pick = is_top[np.r_[True, here[is_top][1:] != here[is_top][:-1]]]  # the first best of each node
            better = top > best[nodes]
            nodes, pick = nodes[better], pick[better]
            best[nodes], feature[nodes], code[nodes] = top[better], order[slot].take(nodes), key[edge[pick]] - (nodes << bits)
        split = feature >= 0
        nexts = np.cumsum(split) - 1
        threshold = np.zeros(count, np.float32)
        for g in np.unique(feature[split]).tolist():
            at = np.flatnonzero(feature == g)
            threshold[at] = levels[g][0][code[at]]
        out.append({"feature": feature.astype(np.int16), "threshold": threshold, "child": np.where(split, base + count + 2 * nexts, -1).astype(np.int32),
                    "share": (share / np.maximum(total, 1e-300)).T.astype(np.float32)})
        stays = split.take(node)
        rows, node = rows[stays], node[stays]
        node = 2 * nexts.take(node) + (codes.take(rows * width + feature.take(node)) > code.take(node))
        base, count = base + count, 2 * int(split.sum())
    return {k: np.concatenate([o[k] for o in out]) for k in out[0]}


def children(feature: np.ndarray) -> np.ndarray:
    """Left children of the nodes of :func:`grow`, whose inner nodes number theirs one after the other."""
    inner = feature >= 0
    return np.where(inner, 2 * np.cumsum(inner) - 1, -1).astype(np.int32)


def in_ranges(df: DataFrame, row: str) -> DataFrame:
    """``df`` with partitions of ranges of row numbers, sorted by model and number: blocks packed from them
    are ranges of their model's numbers."""
    return df.repartitionByRange(row).sortWithinPartitions("model", row)


def applied(x: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """Class shares of the leaf that each row reaches."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        here = node[rows]
        inner = tree["feature"][here] >= 0
        rows, here = rows[inner], here[inner]
        node[rows] = tree["child"][here] + (x[rows, tree["feature"][here]] > tree["threshold"][here])
    return tree["share"][node]


def large_nodes(rows: RDD, cuts: list[list[np.ndarray]], models: int, classes: int, trees: int, tries: int, seed: int, limit: int) -> dict:
    """Splits of the nodes that hold more than ``limit`` bootstrap rows, level by level."""
    width, bins = len(cuts[0]), 1 + max(len(c) for m in cuts for c in m)
    top: dict[tuple[int, int], dict[int, tuple[int, float]]] = {(m, t): {} for m in range(models) for t in range(trees)}
    fronts = [(m, t, 1) for m in range(models) for t in range(trees)]
    while fronts:
        index = {f: i for i, f in enumerate(fronts)}

        def drawn(b: Block, top=top, index=index) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
            for t in {t for m, t, _ in index if m == b.model}:
                count, node = times(b.row, t, seed), placed(b.x, top[b.model, t])
                for n in np.unique(node).tolist():
                    if (b.model, t, n) in index:
                        at = np.flatnonzero((node == n) & (count > 0))
                        yield index[b.model, t, n], t, n, at, count[at]

        def sizes(out: np.ndarray, b: Block) -> None:
            for i, _, _, at, _ in drawn(b):
                out[i] += len(at)

        n = summed(rows, (len(fronts),), sizes)
        large = [f for f, c in zip(fronts, n) if c > limit]
        index.clear()
        index.update({f: i for i, f in enumerate(large)})
        if not large:
            break

        def add(out: np.ndarray, b: Block) -> None:
            codes = binned(b.x, cuts[b.model]).T.astype(np.int64)
            for i, t, n, at, count in drawn(b):
                for f in range(width):
                    key = codes[at, f] * classes + b.y[at]
                    out[i, f] += np.bincount(key, b.w[at] * count, bins * classes).reshape(bins, classes)

        sums = summed(rows, (len(large), width, bins, classes), add)
        fronts = []
        for (m, t, n), s in zip(large, sums):
            left = np.cumsum(s, axis=1)
            right = left[:, -1:, :] - left
            sizes_l, sizes_r = left.sum(-1), right.sum(-1)
            worth = (left ** 2).sum(-1) / np.maximum(sizes_l, 1e-300) + (right ** 2).sum(-1) / np.maximum(sizes_r, 1e-300)
            worth = np.where((sizes_l > 0) & (sizes_r > 0), worth, -np.inf)
            varied = [f for f in ordered(t, n, width, seed) if np.isfinite(worth[f]).any()][:tries]
            if not varied or (left[0, -1] > 0).sum() < 2:
                continue  # pure or constant: a leaf, which its task finds as well
            f = max(varied, key=lambda f: worth[f].max())
            top[m, t][n] = (int(f), float(cuts[m][f][worth[f].argmax()]))
            fronts += [(m, t, 2 * n), (m, t, 2 * n + 1)]
    return top


def fit(rows: RDD, cuts: list[list[np.ndarray]] | None, models: int, width: int, classes: int, spark, trees: int = 100, seed: int = 42, limit: int = ROWS) -> Forest:
    """``trees`` trees for every model; ``cuts`` None: no model has more than ``limit`` rows.

    A tree takes its rows by block, blocks by their least row number, and by row number inside a block: with
    blocks of ranges of row numbers (``in_ranges``) in the order of these numbers, which need not travel."""
    tries = max(1, int(np.sqrt(width)))
    top = {(m, t): {} for m in range(models) for t in range(trees)}
    if cuts is not None:
        top = large_nodes(rows, cuts, models, classes, trees, tries, seed, limit)
    used = spark.sparkContext.broadcast(top)  # nodes of more than ``limit`` rows

    def dealt(b: Block) -> Iterator[tuple]:
        by = np.argsort(b.row, kind="stable")
        b = Block(b.model, *(v[by] for v in (b.x, b.y, b.w, b.row)))
        columns = [coded(c) for c in (*b.x.T, b.y, b.w)]
        for t in range(trees):
            count = times(b.row, t, seed).astype(np.uint8)
            node = placed(b.x, used.value[b.model, t])
            order = np.flatnonzero(count > 0)
            for n in np.unique(node[order]).tolist():
                at = order[node[order] == n]
                yield (b.model, t, n, len(at), bytearray(b"".join(told(levels, codes[at]) for levels, codes in columns)), bytearray(count[at].tobytes()), int(b.row[0]))

    schema = "model int, tree int, node long, n int, cells binary, times binary, first long"
    # tasks by the work, not by the bytes
    parts = spark.createDataFrame(rows.flatMap(dealt), schema, verifySchema=False).repartition(tasks(spark, models * trees), "model", "tree", "node")
    kinds_of = [np.float32] * width + [np.int32, np.float64]

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        m, t, n = (k.as_py() for k in key)
        table = table.take(np.argsort(np.asarray(table["first"]), kind="stable"))  # the same tree whatever the order of arrival
        *x, y, w = (np.concatenate(c) for c in zip(*(heard(d, k, kinds_of) for d, k in zip(table["cells"].to_pylist(), table["n"].to_pylist()))))
        x = np.stack(x, 1) if x else np.zeros((len(y), 0), np.float32)
        w = w * np.frombuffer(b"".join(table["times"].to_pylist()), np.uint8)
        made = grow(x, y, w, classes, tries, np.random.default_rng([seed, m, t, n]))
        made["share"][made["feature"] >= 0] = 0.0  # a leaf's share is read
        cells = [m, t, n, len(made["feature"]), *(made[c].tobytes() for c in ("feature", "threshold", "share"))]
        names = ("model", "tree", "node", "n", "feature", "threshold", "share")
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3)
        return pa.table({c: pa.array([v], k) for c, v, k in zip(names, cells, kinds)})

    return Forest(trees, classes, top, stored(parts.groupBy("model", "tree", "node").applyInArrow(finish, SUBTREE), "forest"))


def shares(rows: DataFrame, forest: Forest, width: int, bundle: int = BUNDLE) -> DataFrame:
    """model, part, row, share (float64 bytes): mean class shares of the blocks (model, part, x, row bytes)."""
    classes, top, number = forest.classes, forest.top, forest.trees  # not the table of subtrees
    bundles = -(-forest.trees // bundle)
    trees = forest.subtrees.withColumn("bundle", F.floor(F.col("tree") / bundle).cast("int"))
    each = rows.select(F.col("model").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("to"), "part", "x", "row")

    def vote(key, left: pa.Table, right: pa.Table) -> pa.Table:
        m = key[0].as_py()
        grown: dict[int, dict[int, dict[str, np.ndarray]]] = {}
        for r in left.to_pylist():
            feature = np.frombuffer(r["feature"], np.int16)
            grown.setdefault(r["tree"], {})[r["node"]] = {
                "feature": feature, "threshold": np.frombuffer(r["threshold"], np.float32),
                "child": children(feature), "share": np.frombuffer(r["share"], np.float32).reshape(-1, classes)}
        out = {"model": [], "part": [], "row": [], "votes": []}
        for r in right.to_pylist():
            x = np.frombuffer(r["x"], np.float32).reshape(-1, width)
            total = np.zeros((len(x), classes))
            for t, pieces in sorted(grown.items()):
                node = placed(x, top[m, t])
                for n in np.unique(node).tolist():
                    at = np.flatnonzero(node == n)
                    if n in pieces:
                        total[at] += applied(x[at], pieces[n])
            for c, v in zip(out, (m, r["part"], r["row"], total.tobytes())):
                out[c].append(v)
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))})

    n = tasks(rows.sparkSession, len(top) // bundle)
    trees, each = trees.repartition(n, "model", "bundle"), each.repartition(n, "of", "to")
    votes = trees.groupBy("model", "bundle").cogroup(each.groupBy("of", "to")).applyInArrow(vote, "model int, part long, row binary, votes binary")

    def joined(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in table["votes"].to_pylist()) / number
        return pa.table({"model": table["model"][:1], "part": table["part"][:1], "row": table["row"][:1], "share": pa.array([total.tobytes()], pa.binary())})

    return votes.groupBy("model", "part").applyInArrow(joined, "model int, part long, row binary, share binary")

