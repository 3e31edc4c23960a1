"""Streaming forms of two batch jobs (extensions X1, X2; not in the reference).

X1: hourly counts per series with an event-time watermark, and the gap-filled hourly
    series (A16) made of them by a keyed state.
X2: a stream of risk requests scored by a stream-static join against the
    precomputed risk cube of U2 (static side: one row per hour x day x
    condition pattern, bounded by the code domains).
Both use a file source (new parquet files in a folder) and can run with
``trigger(availableNow=True)`` as restartable incremental batch jobs; the
checkpoint folder makes them survive restarts and lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crashlens.sources import schemas


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(schemas.EVENTS).parquet(folder)


def hourly_counts_stream(events: DataFrame, series_key: str = "event_type", delay: str = "1 hour") -> DataFrame:
    """Tumbling 1-hour windows per series and for 'ALL', late rows within
    ``delay`` still counted; state is dropped behind the watermark."""
    # watermarks need zoned timestamps; the session zone is UTC
    keyed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(
        F.explode(F.array(F.col(series_key).cast("string"), F.lit("ALL"))).alias("series_key"), "ts")
    return (keyed.groupBy("series_key", F.window("ts", "1 hour"))
            .agg(F.count(F.lit(1)).alias("y"))
            .select("series_key", F.col("window.start").cast("timestamp_ntz").alias("ts"), "y"))


HOUR_MS = 3_600_000


def counted_hours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per series and hour of a batch, for its series and for 'ALL', with the last time in it."""
    for batch in batches:
        hour = batch["ts"].dt.floor("h")
        for key in (batch["series_key"], pd.Series("ALL", index=batch.index)):
            part = pd.DataFrame({"series_key": key, "hour": hour, "ts": batch["ts"]})
            yield part.groupby(["series_key", "hour"], dropna=False).agg(y=("ts", "size"), ts=("ts", "max")).reset_index()


def closed_hours(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The hours of a series that the watermark has closed, in order, with the zero hours before them.

    State: the last hour told (-1: none) and the counts of the open hours, numbered from 1970."""
    last, hours, counts = state.get if state.exists else (-1, [], [])
    pending, watermark = dict(zip(hours, counts)), state.getCurrentWatermarkMs()
    for batch in batches:
        for hour, y in zip(batch["hour"].to_numpy().astype("datetime64[h]").astype(int).tolist(), batch["y"].tolist()):
            if (hour + 1) * HOUR_MS > watermark:  # else too late
                pending[hour] = pending.get(hour, 0) + y
    closed = sorted(h for h in pending if (h + 1) * HOUR_MS <= watermark)
    if closed:
        told = range(last + 1 if last >= 0 else closed[0], closed[-1] + 1)
        y = [pending.pop(h, 0) for h in told]
        last = closed[-1]
        yield pd.DataFrame({"series_key": key[0], "ts": pd.to_datetime([h * HOUR_MS for h in told], unit="ms"), "y": y})
    state.update((last, list(pending), list(pending.values())))
    if pending:
        state.setTimeoutTimestamp((min(pending) + 1) * HOUR_MS)


def hourly_series_stream(events: DataFrame, series_key: str = "event_type", delay: str = "1 hour") -> DataFrame:
    """The gap-filled hourly series (A16) as a stream.

    Events are counted per series and hour where they are read, so a state task gets counts
    however hot a series is.  The state of a series holds its open hours and sets a timer at
    the end of the first one; when the watermark passes it, the hour is told, after the hours
    without events since the last one told as zeros.  Rows of closed hours are too late."""
    rows = events.where("ts IS NOT NULL").select(F.col(series_key).cast("string").alias("series_key"), F.col("ts").cast("timestamp").alias("ts"))
    # watermarks need zoned timestamps; the session zone is UTC
    counts = rows.mapInPandas(counted_hours, "series_key string, hour timestamp, y bigint, ts timestamp").withWatermark("ts", delay)
    return counts.groupBy("series_key").applyInPandasWithState(
        closed_hours, "series_key string, ts timestamp_ntz, y bigint", "last bigint, hours array<bigint>, counts array<bigint>",
        "append", GroupStateTimeout.EventTimeTimeout)


def score_requests_stream(requests: DataFrame, cube: DataFrame) -> DataFrame:
    """U2 on a request stream (stream-static left join per micro-batch) against a
    written :func:`crashlens.operators.risk.risk_cube`."""
    from crashlens.operators.risk import score_requests
    return score_requests(cube, requests)


def run_available_now(df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append"):
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", sink_path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
