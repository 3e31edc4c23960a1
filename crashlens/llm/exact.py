"""Exact dedup: a stateful stream keeps, per text digest, the row to keep and its place.

The documents are read as a stream.  A streaming aggregation holds, in RocksDB
state that never expires, one entry for each digest: the largest doc_id, where
its content lies (file and row), and the number of rows.  Each micro-batch writes
the entries it changed under its batch id, so a repeated batch overwrites itself.
Digests met more than once are hits: their rows' full bytes are compared, so texts
of one digest that differ form groups of their own.

Edge cases: null counts as the empty text; equal texts need equal bytes; among
rows that repeat the kept doc_id all are marked kept; a null id is kept only if
its group has no other; an empty table gives an empty table.  Only DataFrame and
streaming functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.llm.common import scratch, written

#: Disk-backed state.  Each partition is a small database of its own, which must not
#: set disk space aside in advance.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Hits are spread over so many parts before their bytes are compared, so that one
#: text with a third of all rows does not meet in one task.
PARTS = 16


def digested(docs: DataFrame, *more) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *more)


def digest_state(spark: SparkSession, path: str, bytes_per_batch: int) -> DataFrame:
    """digest, keep (struct doc_id, file, row), n after the stream has read all files of ``path``."""
    path, place = path.rstrip("/"), scratch(spark, "exact-state")
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        schema = spark.read.parquet(path).schema
        pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only by a pattern
        rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(pattern)
        entry = F.struct("doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        state = digested(rows, entry.alias("entry")).groupBy("digest").agg(F.max("entry").alias("keep"), F.count("*").alias("n"))

        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{place}/entries/batch={batch_id}")

        stream = state.writeStream.outputMode("update").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True)
        stream.foreachBatch(save).start().awaitTermination()
        columns = state.schema.add("batch", "integer")
        empty = spark.read.parquet(path).isEmpty()  # no batch ran, nothing was saved
        saved = spark.createDataFrame([], columns) if empty else spark.read.schema(columns).parquet(f"{place}/entries")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # counts and the largest id only grow, so the last entry of a digest has the largest of both
    return saved.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))


def deduplicate(spark: SparkSession, path: str, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, digest, keep_id, keep_file,
    keep_row, group_size, kept."""
    entries = written(digest_state(spark, path, bytes_per_batch), "exact-entries")
    docs = spark.read.parquet(path)
    hits = entries.where("n > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part")
    same = digested(docs, text, part).join(hits, ["digest", "part"]).groupBy("digest", "bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("size"))
    checked = written(same.groupBy("digest").agg(
        F.count("*").alias("texts"), F.max("keep_id").alias("checked_id"),
        F.when(F.count("*") > 1, F.collect_list(F.struct("bytes", "keep_id", "size"))).alias("apart"),
    ), "exact-checked")
    place = [F.col("keep.doc_id").alias("keep_id"), F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row")]
    alone = entries.join(checked.where("texts > 1").select("digest"), "digest", "left_anti").select("digest", *place, F.col("n").alias("group_size"))
    result = digested(docs).join(alone, "digest")
    if not checked.where("texts > 1").isEmpty():  # different texts of one digest: their bytes decide
        groups = checked.where("texts > 1").select("digest", F.explode("apart").alias("g"))
        groups = groups.select("digest", F.col("g.bytes").alias("bytes"), F.col("g.keep_id").alias("keep_id"), F.lit(None).cast("string").alias("keep_file"), F.lit(None).cast("long").alias("keep_row"), F.col("g.size").alias("group_size"))
        result = result.unionByName(digested(docs, text).join(groups, ["digest", "bytes"]).drop("bytes"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
