"""Ranks of many rows without a window over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_ranks(df: DataFrame, group: Sequence[str], key: Column, ties: Sequence[str], out: str, bits: int = 16) -> DataFrame:
    """``out``: the row's rank (from 0) in its group in the order of ``key``, a
    64-bit hash, and ``ties``.

    The hash's high bits are its bucket, so buckets lie in rank order and hold
    equal shares: a bucket's offset comes from the bucket counts (2^bits rows per
    group at most), and only the rows of one bucket are ordered together.  The
    rank is the same for any ``bits``.
    """
    keyed = df.withColumn("__h", key).withColumn("__b", F.shiftright("__h", 64 - bits))
    counts = keyed.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    own = Window.partitionBy(*group, "__b").orderBy("__h", *ties)
    return (keyed.join(offsets, [*group, "__b"])
            .withColumn(out, F.col("__off") + F.row_number().over(own) - 1).drop("__h", "__b", "__off"))
