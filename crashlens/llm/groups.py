"""Documents dealt into groups of bounded size that stay together through several joins.

``dealt`` writes the documents once, bucketed by group, to the shared scratch
folder.  Tables of requests and replies then meet a group's documents by
``cogroup`` on its number, and the bucketed side is not shuffled again.
"""

from __future__ import annotations

import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import plain, scratch


def dealt(docs: DataFrame, name: str, per_partition: int = 2) -> DataFrame:
    """grp int, doc_id, text.  ``spark.sql.shuffle.partitions`` is set for the input's size,
    so ``per_partition`` times as many groups bound a group's size."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = plain(docs).select(number(parts * per_partition).alias("grp"), "doc_id", "text")
    return bucketed(rows.repartition(parts, "grp"), name, parts)


def number(n: int):
    return F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n)).cast("int")


def bucketed(rows: DataFrame, name: str, buckets: int) -> DataFrame:
    """``rows`` as an external table in the scratch folder, bucketed by ``grp``."""
    spark = rows.sparkSession
    table = f"llm_{name}_{uuid.uuid4().hex[:12]}"
    writer = rows.write.option("compression", "zstd").option("path", scratch(spark, name))
    writer.bucketBy(buckets, "grp").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: an external table's files stay
    return out


def destinations(table: DataFrame, bytes_each: int = 6 << 20) -> int:
    """Parts that keys of the words of ``table`` are dealt to: one for so many bytes of text
    (about a million words), so a part's size is bounded and the number of (group, part)
    rows stays below that of the words."""
    total = table.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-total // bytes_each))


def one(table: pa.Table, column: str):
    """The first value of a column that is the same in all rows."""
    return table.column(column)[0].as_py()


class WordValues(dict):
    """Word -> its 64-bit value, filled as words are met."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_values(texts: list[bytes], known: WordValues) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit value of each word of all texts, number of words of each text)."""
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum())), sizes


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_MULTIPLIER = 0x9E3779B97F4A7C15


def window_values(values: np.ndarray, length: int) -> np.ndarray:
    """Value of each run of ``length`` neighbours (by doubling); the last length-1 entries
    are of shorter runs and to be ignored."""
    def joined(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        out = a * np.uint64(_MULTIPLIER)
        out ^= out >> np.uint64(29)
        out[: max(0, len(a) - step)] += b[step:]
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return out

    power, size = values, 1
    out, have = None, 0
    while size <= length:
        if length & size:
            out, have = (power, size) if out is None else (joined(power, out, size), have + size)
        if size * 2 <= length:
            power = joined(power, power, size)
        size *= 2
    return out
