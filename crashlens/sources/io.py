"""Readers and sinks.

CSV columns are bound by header name and cast to a declared schema; values that
do not fit are listed and counted instead of failing or guessing.  Outputs are parquet,
partitioned by year/month so date filters prune files.  Writes replace whole
outputs (``overwrite``), so a retried job leaves one consistent copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashlens.sources import schemas


REJECTS = "_rejects"
# names that the published files use for declared columns
ALIASES = {"date_of_accident": "date", "time_of_accident": "time", "raw_date": "date", "raw_time": "time"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, date_format: str = "dd/MM/yyyy") -> DataFrame:
    """Files with a header, in any column order.

    Columns are bound by their header names (or :data:`ALIASES`) and cast to the
    declared types; declared columns that a file lacks are NULL, and columns that
    are not declared follow as text.  ``_rejects`` lists the declared columns whose
    text does not fit the type (empty for a good row); see :func:`reject_counts`.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    declared = {f.name: f for f in schema.fields}
    found = {n: n if n in raw.columns else ALIASES.get(n) for n in declared}
    found = {n: c for n, c in found.items() if c in raw.columns}
    others = [c for c in raw.columns if c not in declared and c not in found.values()]
    # three plain steps (texts, values, rejects) rather than one deep expression per column
    texts = raw.select(*[F.trim(F.col(f"`{c}`")).alias(f"__{n}") for n, c in found.items()], *[F.col(f"`{c}`") for c in others])
    typed = []
    for n, f in declared.items():
        text = F.col(f"__{n}")
        if n not in found:
            value = F.lit(None).cast(f.dataType)
        elif isinstance(f.dataType, T.DateType):
            value = F.coalesce(F.try_to_date(text, date_format), F.try_to_date(text, "yyyy-MM-dd"))
        elif isinstance(f.dataType, T.StringType):
            value = F.when(text != "", text)
        else:
            value = text.try_cast(f.dataType)
        typed.append(value.alias(n, metadata=f.metadata))
    values = texts.select(*typed, *[F.col(f"__{n}") for n in found], *[F.col(f"`{c}`") for c in others])
    bad = [F.when((F.col(f"__{n}") != "") & F.col(n).isNull(), F.lit(n)) for n in found]
    rejects = F.array_except(F.array(*bad), F.array(F.lit(None).cast("string"))) if bad else F.array().cast("array<string>")
    return values.select(*declared, *[F.col(f"`{c}`") for c in others], rejects.alias(REJECTS))


def reject_counts(df: DataFrame) -> DataFrame:
    """column_name, n: rows whose value did not fit the declared type."""
    return df.select(F.explode(REJECTS).alias("column_name")).groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))


def accepted(df: DataFrame) -> DataFrame:
    """The rows without a reject."""
    return df.where(F.size(REJECTS) == 0).drop(REJECTS)


def read_collisions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.COLLISION)


def read_vehicles(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.VEHICLE)


def read_casualties(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CASUALTY)


def with_ingest_time(df: DataFrame) -> DataFrame:
    """S2 default: ``created_at`` when the source has none."""
    return df if "created_at" in df.columns else df.withColumn("created_at", F.current_timestamp())


def write_parquet(df: DataFrame, path: str, partition_by=()) -> None:
    """Replace the output."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_partitioned_by_month(df: DataFrame, path: str, ts_col: str = "date_of_accident") -> None:
    """year/month partitions; rows sorted by time inside files so
    parquet min/max statistics prune row groups for time filters."""
    out = df.withColumn("year", F.year(ts_col)).withColumn("month", F.month(ts_col))
    (out.repartition("year", "month").sortWithinPartitions(ts_col)
     .write.mode("overwrite").partitionBy("year", "month").parquet(path))


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", encoding).csv(path)


def register_views(spark: SparkSession, views: dict[str, DataFrame]) -> None:
    """Named views (the SQL scripts' views) for ``spark.sql`` users."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
