"""Exact top-k by inner product, pruned with segment statistics coarse to fine.

Vectors are quantised to integers floor(scale * x).  A vector is cut into segments
of l components with mean m and deviation s.  For two vectors the squared distance
is at least the sum of l * ((m - m')^2 + (s - s')^2) over the segments, so, with both
lengths known, their inner product is at most the sum of l * (m * m' + s * s').  Both
bounds order candidates alike; they get closer as segments get shorter.  For a tile
of queries the bounds of all candidates at the coarsest resolution are compared with
each query's threshold (a score that k candidates reach); those that fail are left,
the others meet the next resolution, and the survivors' exact scores are computed.
The candidates with the best bounds are scored early, which raises the threshold.

On Spark, queries and candidates are dealt into blocks of bounded size; every block
of queries meets every block of candidates in a group of its own (a stated query set
against all rows, in blocks).  A first pass against one block of candidates gives
each query a threshold that holds everywhere; blocks then return at most k rows for
a query, and a ranking per query joins them.  Nothing is broadcast or collected but
two counts.

Edge cases: null vectors and those with a null, NaN or infinite component take no
part, neither as query nor as candidate; vectors of unequal lengths have no inner
product and are never paired; empty vectors score 0 with each other; repeated rows
are candidates of each other, and a repeated query row has results of its own; ties
go to the smaller id, a null id counts as largest; fewer than k candidates are all
returned; a score beyond 64 bits counts as the nearest 64-bit number; an empty
table gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlens.llm.common import as_batch, written

#: Components of a segment, coarse to fine; a vector of other length ends with a shorter segment.
LENGTHS = (64, 16, 4, 2)
#: Most rows of a block on average; a group holds one block of either side.
QUERIES, CANDIDATES = 16_384, 8_192
#: Queries whose bounds to a block's candidates are in memory at once.
TILE = 256
#: Components up to this size give exact sums of products in 64-bit floats (with 2^20 of them).
TAME = float(1 << 16)
#: The least 64-bit number: no threshold yet.
LOWEST = -(1 << 63)
FOUND = "query long, query_id long, vec_id long, score long"


def summaries(x: np.ndarray, length: int) -> np.ndarray:
    """Per row, sqrt(l) * mean and sqrt(l) * deviation of each segment: products of two rows
    of it bound those of the vectors."""
    cuts = np.arange(0, x.shape[1], length)
    if not len(cuts):
        return np.zeros((len(x), 1))
    sizes = np.diff(np.append(cuts, x.shape[1])).astype(float)
    total, squares = np.add.reduceat(x, cuts, axis=1), np.add.reduceat(x * x, cuts, axis=1)
    spread = np.sqrt(np.maximum(squares - total * total / sizes, 0.0))
    return np.concatenate([total / np.sqrt(sizes), spread], axis=1)


def wild(x: np.ndarray) -> np.ndarray:
    """Rows whose sums of products may not be exact in floats."""
    return np.abs(x).max(axis=1, initial=0.0) > TAME


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, as 64-bit integers."""
    wild_a, wild_b = wild(a), wild(b)
    out = (np.where(wild_a[:, None], 0.0, a) @ np.where(wild_b[:, None], 0.0, b).T).astype(np.int64)
    if wild_a.any() or wild_b.any():  # exact integers of any size
        whole = lambda x: [[int(v) for v in r] for r in x.tolist()]
        rows_a, rows_b = whole(a), whole(b)
        for i in range(len(a)):
            for j in range(len(b)) if wild_a[i] else np.flatnonzero(wild_b):
                out[i, j] = min(max(sum(u * v for u, v in zip(rows_a[i], rows_b[j])), LOWEST), -LOWEST - 1)
    return out


def best(scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id, missing ids last."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], missing[some], ~scores[some]))][:k]  # ~s falls as s rises, without overflow


def search(q: np.ndarray, own: np.ndarray, least: np.ndarray, c: np.ndarray, rows: np.ndarray, ids: np.ndarray,
           missing: np.ndarray, k: int, lengths: Sequence[int] = LENGTHS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places of its best candidates, their scores): of the candidates ``c`` with row numbers
    ``rows`` and ids ``ids``, the k best of each query that reach ``least`` and are not its own row."""
    with np.errstate(over="ignore", invalid="ignore"):
        levels = [(summaries(q, n), summaries(c, n)) for n in lengths]
        slack = 1e-9 * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1).max(initial=0.0) + 1e-6
    wild_q, wild_c = wild(q), wild(c)
    for lo in range(0, len(q), TILE):
        t = slice(lo, lo + TILE)
        tile, at_least = q[t], np.where(least[t] > LOWEST, least[t].astype(float), -np.inf)
        here = np.arange(len(c))
        alive = own[t, None] != rows[None, :]
        for sq, sc in levels:
            with np.errstate(over="ignore", invalid="ignore"):
                bound = sq[t] @ sc[here].T + slack[t]
            bound = np.where(np.isfinite(bound), bound, np.inf)
            bound[~alive] = -np.inf
            if len(here) > k:  # score the most promising: k scores are a threshold
                tops = np.argpartition(bound, len(here) - k, axis=1)[:, len(here) - k:]
                real = np.take_along_axis(alive & ~(wild_q[t, None] | wild_c[here]), tops, 1).all(axis=1)
                scored = np.einsum("qd,qkd->qk", tile[real], c[here[tops[real]]])
                at_least[real] = np.maximum(at_least[real], scored.min(axis=1))
            alive &= bound >= at_least[:, None]
            some = alive.any(axis=0)
            here, alive = here[some], alive[:, some]
        scores = products(tile, c[here])
        for i in range(len(tile)):
            mine = np.flatnonzero(alive[i] & (scores[i] >= least[lo + i]))
            mine = mine[best(scores[i][mine], ids[here[mine]], missing[here[mine]], k)]
            if len(mine):
                yield lo + i, here[mine], scores[i][mine]


def matrix(column: pa.ChunkedArray, size: int, scale: float) -> np.ndarray:
    """Quantised vectors of ``size`` components as rows of floats (exact integers)."""
    flat = pa.concat_arrays([x.flatten() for x in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    x = np.asarray(flat, dtype=np.float64).reshape(len(column), size)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -1e300, 1e300)


def finite(vector: Column) -> Column:
    """The vector is there and so are all its components, which are finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def compare(queries: DataFrame, candidates: DataFrame, k: int, scale: float, lengths: Sequence[int]) -> DataFrame:
    """FOUND rows of every pair of blocks: at most k for a query and a block of candidates."""
    def pair(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        parts = []
        size = key[2].as_py()
        if left.num_rows and right.num_rows:
            own, least = np.asarray(left["row"]), np.asarray(left["least"])
            given, missing = np.asarray(right["c_id"].fill_null(0)), np.asarray(right["c_id"].is_null())
            found = search(matrix(left["vector"], size, scale), own, least, matrix(right["c_vector"], size, scale),
                           np.asarray(right["c_row"]), given, missing, k, lengths)
            for i, places, scores in found:
                parts.append(as_batch(schema, np.full(len(places), own[i]), pa.repeat(left["vec_id"][i], len(places)),
                                      pa.array(given[places], pa.int64(), mask=missing[places]), scores))
        return pa.Table.from_batches(parts, schema)

    left, right = queries.groupBy("query_block", "block", "size"), candidates.groupBy("to", "part", "width")
    return left.cogroup(right).applyInArrow(pair, FOUND)


def top_k(vectors: DataFrame, wanted: Column, k: int = 5, scale: float = 256.0, vector: str = "embedding", vec_id: str = "vec_id",
          lengths: Sequence[int] = LENGTHS, per_queries: int = QUERIES, per_candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row for which ``wanted`` holds,
    out of all other rows."""
    spark = vectors.sparkSession
    kind = "double" if "double" in vectors.schema[vector].dataType.simpleString() else "float"
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), wanted.alias("wanted"),
                          F.col(vector).cast(f"array<{kind}>").alias("vector")).where(finite(F.col("vector")))
    rows = written(rows.withColumn("size", F.size("vector")), "search-rows")
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("wanted"), 1))).first()
    many, blocks = max(1, -(-asked // per_queries)), max(1, -(-n // per_candidates))
    dealt = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    queries = rows.where("wanted").select("row", "vec_id", "size", "vector", dealt(many).alias("query_block"))
    # names of their own: both sides come from one table
    candidates = rows.select(F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("to"), dealt(blocks).alias("part"), F.col("size").alias("width"),
                             F.col("row").alias("c_row"), F.col("vec_id").alias("c_id"), F.col("vector").alias("c_vector"))
    lowest = F.lit(LOWEST).cast("long")
    first = compare(queries.withColumns({"least": lowest, "block": F.lit(0)}), candidates.where("part = 0"), k, scale, lengths)
    reached = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("reached"))
    reached = written(reached, "search-thresholds")
    queries = queries.join(reached, queries["row"] == reached["query"], "left").drop("query")
    queries = queries.withColumn("least", F.coalesce("reached", lowest)).drop("reached")
    every = compare(queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), candidates, k, scale, lengths)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
