"""Training rows as numpy blocks, and sums over all blocks.

Several models (the folds of a cross-validation) are fitted side by side: a row
belongs to the model that its ``model`` column names.  Rows are packed inside their
partitions, written once to the shared folder and kept in memory as blocks of at
most ``SIZE`` rows; a fitting step is one pass that adds an array per partition and
joins the arrays by a tree, so the driver receives one array of the model's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.session import checkpoint_dir, discard, stored

SIZE = 16_384
#: Bytes of feature values that a partition holds at most, about.
PARTITION_BYTES = 32 << 20
#: Bytes that the driver adds up itself in one pass.
DRIVER_BYTES = 64 << 20


@dataclass
class Block:
    """Rows of one model: values (n, features), classes, weights and 64-bit row numbers."""

    model: int
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    row: np.ndarray
    state: np.ndarray | None = None

    def with_state(self, state: np.ndarray) -> Block:
        return replace(self, state=state)


def packed(df: DataFrame, features: Sequence[str], label: str, weight: str, row: str, size: int = SIZE) -> DataFrame:
    """model, n, x (float32), y (int32), w (float64), row (int64) as bytes."""
    names = list(features)
    schema = pa.schema([("model", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("x", "y", "w", "row"))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def out(m: int) -> pa.RecordBatch:
            x, y, w, row = (np.concatenate(parts) for parts in zip(*held.pop(m)))
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((m, len(y), x.tobytes(), y.tobytes(), w.tobytes(), row.tobytes()), schema)], schema=schema)

        for batch in batches:
            x = np.stack([np.asarray(batch.column(c), np.float32) for c in names], 1) if names else np.zeros((batch.num_rows, 0), np.float32)
            y, w, row = (np.asarray(batch.column(c), t) for c, t in zip(("y", "w", "row"), (np.int32, np.float64, np.int64)))
            model = np.asarray(batch.column("model"))
            for m in np.unique(model).tolist():
                at = np.flatnonzero(model == m)
                for lo in range(0, len(at), size):
                    some = at[lo:lo + size]
                    held.setdefault(m, []).append((x[some], y[some], w[some], row[some]))
                    if sum(len(p[1]) for p in held[m]) >= size:
                        yield out(m)
        for m in list(held):
            yield out(m)

    values = [F.col(c).cast("double").alias(c) for c in names]
    rows = df.select(F.col("model").cast("int"), F.col(label).cast("int").alias("y"), F.col(weight).cast("double").alias("w"), F.col(row).alias("row"), *values)
    return rows.mapInArrow(pack, "model int, n int, x binary, y binary, w binary, row binary")


def blocks(df: DataFrame, features: Sequence[str], label: str = "label", weight: str = "weight", row: str = "row") -> RDD:
    """The rows of ``df`` (with ``model``, ``label``, ``weight`` and 64-bit ``row``) as a kept RDD of blocks,
    until they are :func:`released`."""
    spark = df.sparkSession
    table = stored(packed(df, features, label, weight, row), "blocks")
    width = len(features)
    size = 4 * width * table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # of the values, which are not read for it
    parts = max(spark.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))

    def unpacked(r) -> Block:
        return Block(r["model"], np.frombuffer(r["x"], np.float32).reshape(-1, width), np.frombuffer(r["y"], np.int32),
                     np.frombuffer(r["w"], np.float64), np.frombuffer(r["row"], np.int64))

    rows = table.rdd.map(unpacked).repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
    rows.table = table
    return rows


def coded(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a block's column, bit by bit, and the number of each row's value."""
    levels, codes = np.unique(np.ascontiguousarray(column).view(f"u{column.itemsize}"), return_inverse=True)
    return levels, codes.astype(np.min_scalar_type(max(len(levels) - 1, 0)))


class Column:
    """A column held as the numbers of its values where these take fewer bytes."""

    def __init__(self, values: np.ndarray):
        levels, codes = coded(values)
        if levels.nbytes + codes.nbytes < values.nbytes:
            self.levels, self.values = levels.view(values.dtype), codes
        else:
            self.levels, self.values = None, np.ascontiguousarray(values)

    def read(self) -> np.ndarray:
        return self.values if self.levels is None else self.levels.take(self.values)


def released(rows: RDD) -> None:
    """Free the memory and the table of :func:`blocks`."""
    rows.unpersist()
    discard(rows.table)


def summed(rows: RDD, shape: tuple[int, ...], add: Callable[[np.ndarray, Block], None]) -> np.ndarray:
    """The sum over all blocks of what ``add(total, block)`` adds to an array of ``shape``."""
    def part(each: Iterator[Block]) -> Iterator[np.ndarray]:
        total = np.zeros(shape)
        for block in each:
            add(total, block)
        yield total

    sums = rows.mapPartitions(part)
    # one level where all partitions' arrays are few bytes to the driver, else a tree
    few = sums.getNumPartitions() * 8 * int(np.prod(shape)) <= DRIVER_BYTES
    return sums.treeReduce(np.add, depth=1 if few else 2)


def advanced(rows: RDD, step: Callable[[Block], Block], stored: bool) -> RDD:
    """``step`` of every block, kept in memory when the next pass makes it; ``stored``: that pass
    also checkpoints it to the shared folder, where its lineage ends."""
    new = rows.map(step).persist(StorageLevel.MEMORY_AND_DISK)
    if stored:
        checkpoint_dir(SparkSession.active())
        new.checkpoint()
    return new
