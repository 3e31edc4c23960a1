"""Shared helpers of the text operators: scratch tables, input normalising, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of text or ids that one Arrow batch made by an operator holds.
BATCH_BYTES = 8 << 20
#: Folder of each scratch table that is in use.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; operators take any path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    A folder of its own is made only where the setting is absent and the
    session runs in one process (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder, read again: lineage ends
    there, and a lost executor costs no more than the reading task."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PLACES[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that :func:`written` made and that no plan still to run reads.

    Frames that are not such a table are passed over."""
    for table in tables:
        path = _PLACES.pop(table, None)
        if path:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def plain(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``; a null text counts as the empty text."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_mod(doc_id, n: int):
    """crc32 of the id written as text, mod ``n``; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes in ``column`` (one row at least)."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
            if i > start and size + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if batch.num_rows > start:
            yield batch.slice(start)


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
