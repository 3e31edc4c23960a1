"""Time series jobs: gap-filled counts, rolling windows, baselines (A16, A17,
A24, A25, W1, W2, W7-W9, T1, T2).

Scale rule: rows are first aggregated to one row per (series_key, period),
so windows run over periods (days or hours of the covered span), never over
raw events.  Every window is partitioned by ``series_key``; many series
(districts, police forces, event types) spread over many tasks, and one
series holds at most one row per period of its span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlens.functions.expr import start_of

KEY = "series_key"


def _key(series_key: str | Column | None) -> Column:
    if series_key is None:
        return F.lit("ALL")
    return (F.col(series_key) if isinstance(series_key, str) else series_key).cast("string")


def counts_per_period(df: DataFrame, ts: str, unit: str, series_key=None, also_all: bool = False) -> DataFrame:
    """Count rows per the start of ``ts``'s hour or day and series.

    With ``also_all`` every row feeds its own series and the 'ALL' series in the
    same scan (``explode`` of a two-element array before the aggregate).
    """
    key = _key(series_key)
    if also_all and series_key is not None:
        key = F.explode(F.array(key, F.lit("ALL")))
    per = df.select(key.alias(KEY), start_of(unit, ts).alias("ts"))
    return per.filter(F.col("ts").isNotNull()).groupBy(KEY, "ts").agg(F.count(F.lit(1)).alias("y"))


def gap_fill(counts: DataFrame, step: str) -> DataFrame:
    """Fill missing periods between each series' first and last with 0.

    The grid per series comes from ``sequence(min, max, step)``; its size is the
    time span, not the data volume.  The grid is joined to the counts on
    (series_key, ts): both sides are already aggregated.
    """
    bounds = counts.groupBy(KEY).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    grid = bounds.select(KEY, F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step}"))).alias("ts"))
    return (grid.join(counts, [KEY, "ts"], "left")
            .select(KEY, "ts", F.coalesce(F.col("y"), F.lit(0)).cast("bigint").alias("y")))


def hourly_series(df: DataFrame, ts: str = "ts", series_key=None, also_all: bool = False) -> DataFrame:
    """A16."""
    return gap_fill(counts_per_period(df, ts, "hour", series_key, also_all), "1 HOUR")


def daily_series(df: DataFrame, day: Column | str, series_key=None, also_all: bool = False) -> DataFrame:
    """Counts per calendar day, gap-filled (``resample('D').size()``)."""
    d = F.col(day) if isinstance(day, str) else day
    src = df.withColumn("__day", d.cast("timestamp_ntz"))
    return gap_fill(counts_per_period(src, "__day", "day", series_key, also_all), "1 DAY")


def parsed_day(raw_date: str = "raw_date", fmt: str = "dd/MM/yyyy") -> Column:
    """Explicit day-first date parsing; invalid dates give NULL and are dropped."""
    return F.try_to_date(F.col(raw_date), fmt)


def _w(series_key: str | None, order: str) -> Window:
    return (Window.partitionBy(series_key) if series_key else Window.partitionBy()).orderBy(order)


def daily_trend_rolling(collision: DataFrame, series_key: str | None = None, lag_days: int = 30, calendar: bool = False) -> DataFrame:
    """Per day with accidents, 7-row rolling mean/max and a 30-row lag.

    ``calendar``: frames of days instead of rows, so days without accidents count as gaps:
    the mean and maximum of the days with accidents among the last seven, and the value
    exactly ``lag_days`` before (NULL if there is none)."""
    keys = [series_key] if series_key else []
    daily = collision.groupBy(*keys, "date_of_accident").agg(
        F.count(F.lit(1)).alias("daily_accidents"),
        F.avg("number_of_casualties").alias("avg_daily_casualties"))
    w = _w(series_key, "date_of_accident")
    roll, lag = w.rowsBetween(-6, 0), F.lag("daily_accidents", lag_days).over(w)
    if calendar:
        days = (Window.partitionBy(*keys)).orderBy(F.unix_date("date_of_accident"))
        # one row per day, so a frame of one day holds its value
        roll, lag = days.rangeBetween(-6, 0), F.max("daily_accidents").over(days.rangeBetween(-lag_days, -lag_days))
    return daily.select(*keys, "date_of_accident", "daily_accidents", "avg_daily_casualties",
                        F.avg("daily_accidents").over(roll).alias("rolling_7day_avg"),
                        F.max("daily_accidents").over(roll).alias("rolling_7day_max"),
                        lag.alias("accidents_30days_ago"),
                        (F.col("daily_accidents") - lag).alias("month_change"))


def forecast_features(collision: DataFrame, series_key: str | None = None) -> DataFrame:
    """Lags 1/7/30, mean and sample stddev of the 7 previous rows, calendar."""
    keys = [series_key] if series_key else []
    d = F.col("date_of_accident")
    daily = collision.groupBy(*keys, "date_of_accident").agg(
        F.count(F.lit(1)).alias("accidents")).withColumn("dow", F.dayofweek(d) - 1).withColumn("month", F.month(d))
    w = _w(series_key, "date_of_accident")
    prev7 = w.rowsBetween(-7, -1)
    return daily.select(
        *keys, "date_of_accident", F.col("accidents").alias("target"),
        F.lag("accidents", 1).over(w).alias("lag_1day"),
        F.lag("accidents", 7).over(w).alias("lag_7days"),
        F.lag("accidents", 30).over(w).alias("lag_30days"),
        F.avg("accidents").over(prev7).alias("rolling_7day_mean"),
        F.round(F.stddev_samp("accidents").over(prev7), 6).alias("rolling_7day_stddev"),
        "dow", "month", F.when(F.col("dow").isin(0, 6), 1).otherwise(0).alias("is_weekend"))


def rolling_mean_full(series: DataFrame, k: int = 7) -> DataFrame:
    """Pandas ``rolling(k).mean()``: NULL until k rows are in the frame."""
    w = Window.partitionBy(KEY).orderBy("ts").rowsBetween(-(k - 1), 0)
    full = F.count(F.lit(1)).over(w) == F.lit(k)
    return series.select(KEY, "ts", "y", F.when(full, F.avg("y").over(w)).alias("rolling_mean"))


def supervised_sequences(series: DataFrame, lookback: int = 24) -> DataFrame:
    """The ``lookback`` previous values as features for the current one."""
    w = Window.partitionBy(KEY).orderBy("ts").rowsBetween(-lookback, -1)
    seq = series.select(KEY, "ts", F.collect_list("y").over(w).alias("x"), "y")
    return seq.filter(F.size("x") == lookback)


def minmax_scaled(series: DataFrame) -> DataFrame:
    """(y - min) / (max - min) per series (min/max via a keyed aggregate)."""
    b = series.groupBy(KEY).agg(F.min("y").alias("__lo"), F.max("y").alias("__hi"))
    return series.join(b, KEY).select(
        KEY, "ts", "y",
        F.round((F.col("y") - F.col("__lo")).cast("double") / F.nullif((F.col("__hi") - F.col("__lo")).cast("double"),
                                                                       F.lit(0.0)), 6).alias("y_scaled"))


def hourly_profile(series: DataFrame) -> DataFrame:
    """Mean value per hour of day."""
    return series.groupBy(KEY, F.hour("ts").alias("hour")).agg(F.avg("y").alias("avg_value"))


def peak_hours_top(series: DataFrame, k: int = 3, key_value: str = "ALL") -> DataFrame:
    """Top-k hours of one series by mean value (ties by hour)."""
    prof = hourly_profile(series.filter(F.col(KEY) == key_value))
    return prof.orderBy(F.desc("avg_value"), "hour").limit(k)


def series_summary(series: DataFrame) -> DataFrame:
    """Length, first/last value, mean, max, min per series."""
    return series.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("length"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.min_by("y", "ts").alias("first_value"), F.max_by("y", "ts").alias("last_value"),
        F.avg("y").alias("mean_value"), F.max("y").alias("max_value"), F.min("y").alias("min_value"))


def forecast_metrics(pred: DataFrame, group=(KEY, "model"), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MAE, RMSE and MAPE with +1 in the denominator (x100), per group."""
    e = F.col(y).cast("double") - F.col(yhat).cast("double")
    valid = pred.filter(F.col(yhat).isNotNull() & F.col(y).isNotNull())
    return valid.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.abs(e)), 6).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(F.avg(F.abs(e / (F.col(y).cast("double") + 1))) * 100, 6).alias("mape"))


def naive_predictions(series: DataFrame, lags=(("naive", 1), ("seasonal_naive", 24))) -> DataFrame:
    """Deterministic reference forecasts (previous value, previous season)."""
    w = Window.partitionBy(KEY).orderBy("ts")
    lagged = series.select(KEY, "ts", "y", *[F.lag("y", k).over(w).alias(f"__l{i}") for i, (_, k) in enumerate(lags)])
    cols = [F.struct(F.lit(name).alias("model"), F.col(f"__l{i}").alias("yhat")) for i, (name, _) in enumerate(lags)]
    return lagged.select(KEY, "ts", "y", F.explode(F.array(*cols)).alias("p")).select(
        KEY, "ts", "y", "p.model", F.col("p.yhat").cast("double").alias("yhat"))


def ma_baseline_metrics(series: DataFrame, window: int = 168, test: int = 720) -> DataFrame:
    """Moving-average baseline (current row included, full windows only)
    scored on the last ``test`` periods of each series."""
    w = Window.partitionBy(KEY).orderBy("ts")
    back = Window.partitionBy(KEY).orderBy(F.desc("ts"))
    frame = w.rowsBetween(-(window - 1), 0)
    pred = series.select(
        KEY, "ts", "y",
        F.when(F.count(F.lit(1)).over(frame) == window, F.avg("y").over(frame)).alias("yhat"),
        F.row_number().over(back).alias("__from_end"))
    scored = pred.filter(F.col("__from_end") <= test).withColumn("model", F.lit("moving_average"))
    return forecast_metrics(scored)
