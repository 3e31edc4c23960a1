"""Exact percentiles from counted values, distributed for any number of values.

Every column is unpivoted and counted by value in one run of its input
(:func:`value_counts`, combined map-side): repeated values cost one row whatever
their number, and raw rows are never shuffled or read again.  The counted rows
are range-sorted and checkpointed to the shared folder (partition numbers stay as
they are when a task is repeated); running counts inside a sorted partition plus
the partitions' offsets give every value its interval of ranks, and the values
that cover a target rank are interpolated as Spark's ``percentile`` does:
``position = p * (n - 1)``, ``(ceil - pos) * v[floor] + (pos - floor) * v[ceil]``.
There is one path for all columns; no task holds more than a sorted partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crashlens.session import checkpoint_dir

KEYS = ("feature", "group_value")
ALL = "ALL"


def value_counts(df: DataFrame, cols: Sequence[str], group: str | None = None, with_all: bool = False) -> DataFrame:
    """feature, group_value, x, c: how often each non-NULL value of ``cols`` occurs, per
    value of ``group`` (NULL groups left out) or under 'ALL' (``with_all``: both), sorted
    and checkpointed."""
    return in_order(counted(df, cols, group, with_all))


def in_order(counts: DataFrame) -> DataFrame:
    """Counted values sorted and checkpointed."""
    checkpoint_dir(counts.sparkSession)
    return counts.orderBy(*KEYS, "x").checkpoint(eager=True)


def counted(df: DataFrame, cols: Sequence[str], group: str | None = None, with_all: bool = False) -> DataFrame:
    """The rows of :func:`value_counts` in any order."""
    entries = []
    for name in cols:
        x = F.col(f"`{name}`").cast("double").alias("x")
        if group:
            entries.append(F.struct(F.lit(name).alias("feature"), F.col(group).cast("string").alias("group_value"), x))
        if not group or with_all:
            entries.append(F.struct(F.lit(name).alias("feature"), F.lit(ALL).alias("group_value"), x))
    rows = df.select(F.explode(F.array(*entries)).alias("r")).select("r.*").where("x IS NOT NULL AND group_value IS NOT NULL")
    return rows.groupBy(*KEYS, "x").agg(F.count(F.lit(1)).alias("c"))


def quantiles(counts: DataFrame, probs: Sequence[float]) -> DataFrame:
    """feature, group_value, q (array of the exact percentiles at ``probs``) of the sorted
    rows of :func:`value_counts`."""
    part = counts.withColumn("p", F.spark_partition_id())
    running = Window.partitionBy("p").orderBy(*KEYS, "x").rowsBetween(Window.unboundedPreceding, 0)
    local = part.withColumn("cum", F.sum("c").over(running))
    totals = part.groupBy("p").agg(F.sum("c").alias("size"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("p", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("off"))
    # one row per sorted partition
    ranked = local.join(F.broadcast(offsets), "p").select(
        *KEYS, "x", (F.col("off") + F.col("cum") - F.col("c")).alias("start"), (F.col("off") + F.col("cum")).alias("stop"))
    groups = ranked.groupBy(*KEYS).agg(F.min("start").alias("first"), (F.max("stop") - F.min("start")).alias("n"))
    # a group's target ranks go to its rows as one small array; a row keeps those it covers
    position = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.array(*[r for i, pos in enumerate(position) for r in (
        F.struct(F.lit(2 * i).alias("slot"), (F.col("first") + F.floor(pos)).alias("rank")),
        F.struct(F.lit(2 * i + 1).alias("slot"), (F.col("first") + F.ceil(pos)).alias("rank")))])
    targets = groups.select(*KEYS, "n", wanted.alias("wanted"))
    hits = ranked.join(targets, list(KEYS)).select(*KEYS, "x", "n", F.explode(F.filter(
        "wanted", lambda t: (t["rank"] >= F.col("start")) & (t["rank"] < F.col("stop")))["slot"]).alias("slot"))
    picked = hits.groupBy(*KEYS).agg(F.first("n").alias("n"), *[
        F.max(F.when(F.col("slot") == s, F.col("x"))).alias(f"v{s}") for s in range(2 * len(probs))])
    values = []
    for i, p in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(pos), F.ceil(pos)
        values.append(F.when(low == high, F.col(f"v{2 * i}")).otherwise(
            (high - pos) * F.col(f"v{2 * i}") + (pos - low) * F.col(f"v{2 * i + 1}")))
    return picked.select(*KEYS, F.array(*values).alias("q"))


def quantile_columns(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row: ``q{i}`` = exact percentiles of ``cols[i]`` at ``probs`` (NULL for a column
    without values)."""
    cols = list(cols)
    if not cols:
        return df.sparkSession.range(1).select()
    q = quantiles(value_counts(df, cols), probs)
    return q.agg(*[F.max(F.when(F.col("feature") == c, F.col("q"))).alias(f"q{i}") for i, c in enumerate(cols)])
