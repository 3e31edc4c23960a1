"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Settings the operators assume (UTC dates, AQE for skew/coalescing).
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot does not JIT-compile methods over 8000 bytes; the wide notebook
    # projections (~50 columns of CASE cleaning/labels) exceed it when fused,
    # so such subtrees fall back to per-operator codegen instead of running
    # one huge interpreted method (2-3x faster on those stages).
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # rows that lie together by accident are joined by accident and vehicle where they are
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}

#: An exchange starts with at least so many partitions and AQE joins neighbours up to its advisory size, so what
#: a task sorts is bounded by that size and not by the input's share of ``spark.sql.shuffle.partitions``.
INITIAL_PARTITIONS = 1000
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Unless the session names them: that size (keys alone take some 25 times their shuffled bytes while they are
#: joined), and the bytes of a file that a task reads (a task holds what it deals to so many partitions).
_BOUNDS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.files.maxPartitionBytes": "16m"}


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "crashlens") -> SparkSession:
    """Local/test session. On a cluster the submitter's session is used as is."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '*')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CRASHLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in _REQUIRED.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators need to an existing session."""
    for k, v in _REQUIRED.items():
        spark.conf.set(k, v)
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(_INITIAL, None) or 0))
    spark.conf.set(_INITIAL, str(max(INITIAL_PARTITIONS, most)))
    for k, v in _BOUNDS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a session that runs in one process (local runs, tests) gets a scratch
    folder when the setting is absent; executors on several machines would not
    see each other's local files.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="crashlens-ckpt-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read again: its plan runs
    once, and a lost executor costs no more than the reading task."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the tables that :func:`stored` wrote and that these plans read; no plan still to
    run may read them."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            at = context._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def stored_by_key(df: DataFrame, name: str, key: str, finish: Callable[[DataFrame], DataFrame] = lambda dealt: dealt) -> DataFrame:
    """``df`` written once as an external table in the shared folder, one sorted file for each
    bucket of ``key``: joins and groups on ``key`` read it without a shuffle or a sort.
    ``finish`` works on the rows once they are dealt to the buckets (a dedup whose key holds ``key``).

    The number of buckets is ``spark.sql.shuffle.partitions``, as set for the input's size."""
    spark = df.sparkSession
    token = uuid.uuid4().hex[:12]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = finish(df.repartition(buckets, key)).write.option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}-{token}")
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(f"crashlens_{name}_{token}")
    return spark.table(f"crashlens_{name}_{token}")
