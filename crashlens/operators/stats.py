"""Accident statistics.

Every job is a hash aggregation on low-cardinality keys (hour, day, slot,
period): partial aggregation on the map side shrinks each input partition to
at most a few hundred rows before the shuffle, whatever the input size or
skew.  Shares of the total use a one-row aggregate appended by broadcast,
never a global window over the raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.functions import codes
from crashlens.functions.expr import attach_one_row, count_when, pct, severity_counts
from crashlens.operators.features import slot_label



def hourly_accident_stats(features: DataFrame) -> DataFrame:
    """A1."""
    return features.groupBy("hour_of_day").agg(
        F.count(F.lit(1)).alias("accident_count"),
        F.avg("number_of_casualties").alias("avg_casualties"),
        F.avg("number_of_vehicles").alias("avg_vehicles"),
        *severity_counts(),
    )


def daily_accident_stats(features: DataFrame) -> DataFrame:
    """A2."""
    return features.groupBy("day_of_week", "day_name").agg(
        F.count(F.lit(1)).alias("accident_count"),
        F.avg("number_of_casualties").alias("avg_casualties"),
        pct(count_when(F.col("collision_severity").isin(1, 2)), F.count(F.lit(1))).alias("serious_fatal_pct"),
    )


def monthly_accident_trends(features: DataFrame) -> DataFrame:
    """A3."""
    return features.groupBy("year", "month", "month_name").agg(
        F.count(F.lit(1)).alias("accident_count"),
        F.avg("number_of_casualties").alias("avg_casualties"),
        F.avg("number_of_vehicles").alias("avg_vehicles"),
    )


def peak_hours(features: DataFrame, k: int = 5) -> DataFrame:
    """Top-k hours with their share of all accidents (ties by hour)."""
    hourly = hourly_accident_stats(features)
    total = hourly.agg(F.sum("accident_count").alias("__total"))
    return (attach_one_row(hourly, total)
            .select("hour_of_day", "accident_count",
                    pct(F.col("accident_count"), F.col("__total")).alias("pct_of_total"),
                    "fatal_count", "serious_count")
            .orderBy(F.desc("accident_count"), F.asc("hour_of_day"))
            .limit(k))


def slot_15min_stats(features: DataFrame) -> DataFrame:
    """A5 + P12."""
    return features.groupBy("time_slot_15min").agg(
        F.count(F.lit(1)).alias("accident_count"),
        F.avg("number_of_casualties").alias("avg_casualties"),
        count_when(F.col("collision_severity").isin(1, 2)).alias("serious_fatal_count"),
    ).select("time_slot_15min", slot_label(F.col("time_slot_15min")).alias("time_label"),
             "accident_count", "avg_casualties", "serious_fatal_count")


def time_period_comparison(features: DataFrame) -> DataFrame:
    """A6 (+ W4 nested share)."""
    g = features.groupBy("time_period").agg(
        F.count(F.lit(1)).alias("accident_count"),
        F.avg("number_of_casualties").alias("avg_casualties"),
        F.avg("number_of_vehicles").alias("avg_vehicles"),
        *severity_counts(names=("fatal", "serious", "slight")),
    )
    total = g.agg(F.sum("accident_count").alias("__total"))
    return attach_one_row(g, total).select(
        "time_period", "accident_count", pct(F.col("accident_count"), F.col("__total")).alias("pct_of_total"),
        "avg_casualties", "avg_vehicles", "fatal", "serious", "slight")


def weekend_vs_weekday(features: DataFrame) -> DataFrame:
    """A7."""
    n = F.count(F.lit(1))
    return features.groupBy("is_weekend").agg(
        n.alias("accident_count"),
        F.avg("number_of_casualties").alias("avg_casualties"),
        pct(count_when(F.col("collision_severity") == 1), n).alias("fatal_rate_pct"),
        pct(count_when(F.col("collision_severity") == 2), n).alias("serious_rate_pct"),
    ).select(F.when(F.col("is_weekend"), "Weekend").otherwise("Weekday").alias("day_type"),
             "accident_count", "avg_casualties", "fatal_rate_pct", "serious_rate_pct")


def seasonal_trends(features: DataFrame) -> DataFrame:
    """A8 + W3: aggregate per month first (12 rows), then LAG over them."""
    n = F.count(F.lit(1))
    g = features.groupBy("month", "month_name").agg(
        n.alias("accident_count"),
        F.avg("number_of_casualties").alias("avg_casualties"),
        pct(count_when(F.col("collision_severity") == 1), n).alias("fatal_pct"),
        pct(count_when(F.col("collision_severity") == 2), n).alias("serious_pct"),
    )
    # at most 12 rows after the aggregate: a single ordered window is cheap
    w = Window.orderBy("month")
    prev = F.lag("accident_count").over(w)
    return g.select("month", "month_name", "accident_count", "avg_casualties",
                    prev.alias("prev_month_count"), (F.col("accident_count") - prev).alias("month_on_month_change"),
                    "fatal_pct", "serious_pct")


def high_risk_windows(features: DataFrame, min_count: int = 50, k: int = 20,
                      levels=(300, 200, 100)) -> DataFrame:
    """Day x hour windows, classified, significant ones, top k."""
    n = F.count(F.lit(1))
    g = features.groupBy("day_name", "day_of_week", "hour_of_day").agg(
        n.alias("accident_count"),
        F.avg("number_of_casualties").alias("avg_casualties"),
        pct(count_when(F.col("weather_conditions").isin(*codes.ADVERSE_WEATHER)), n, 1).alias("adverse_weather_pct"),
        pct(count_when(F.col("light_conditions").isin(*codes.DARK_LIGHT)), n, 1).alias("darkness_pct"),
    ).filter(F.col("accident_count") >= min_count)
    c = F.col("accident_count")
    cls = (F.when(c >= levels[0], "Critical Risk").when(c >= levels[1], "High Risk")
           .when(c >= levels[2], "Medium Risk").otherwise("Low Risk"))
    return (g.select("day_name", "hour_of_day", "accident_count", "avg_casualties",
                     cls.alias("risk_classification"), "adverse_weather_pct", "darkness_pct", "day_of_week")
            .orderBy(F.desc("accident_count"), "day_of_week", "hour_of_day")
            .limit(k)
            .drop("day_of_week"))


def rush_hour_severity(features: DataFrame, lo: int = 15, hi: int = 18) -> DataFrame:
    """accidents in the evening peak by hour and day."""
    return (features.filter(F.col("hour_of_day").between(lo, hi))
            .groupBy("hour_of_day", "day_name").agg(
                F.count(F.lit(1)).alias("total_accidents"),
                count_when(F.col("collision_severity") == 1).alias("fatal"),
                F.avg("number_of_casualties").alias("avg_casualties")))


def high_risk_periods(features: DataFrame, threshold: int = 300) -> DataFrame:
    """hour x day groups above a count threshold."""
    return (features.groupBy("hour_of_day", "day_of_week")
            .agg(F.count(F.lit(1)).alias("accidents"))
            .filter(F.col("accidents") > threshold))
