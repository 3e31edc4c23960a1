"""Validation and data-quality reports (Q1-Q7).

Each report is one aggregate (partial + final) or a keyed aggregate/anti join;
results are tiny, inputs are scanned once with only the needed columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.functions.expr import pct, tod_minutes
from crashlens.operators.joins import orphans


def future_dates(collision: DataFrame, as_of=None) -> DataFrame:
    """Q1: number of dates after ``as_of`` (default today) and the latest."""
    limit = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    return collision.filter(F.col("date_of_accident") > limit).agg(
        F.count(F.lit(1)).alias("future_dates_count"), F.max("date_of_accident").alias("latest_date"))


def invalid_time(collision: DataFrame, time_col: str = "time_of_accident") -> DataFrame:
    """Q2: times outside 00:00-23:59:59 or not of the form HH:mm[:ss]; a missing
    time is not an invalid one (it compares as unknown)."""
    bad = F.col(time_col).isNotNull() & tod_minutes(time_col).isNull()
    return collision.agg(F.count_if(bad).cast("bigint").alias("invalid_time_count"))


def invalid_severity(collision: DataFrame) -> DataFrame:
    """Q3: codes outside 1..3 (NULL is not reported, as with ``NOT IN``)."""
    s = F.col("collision_severity")
    return collision.filter(~s.isin(1, 2, 3)).groupBy("collision_severity").agg(F.count(F.lit(1)).alias("count"))


def null_report(df: DataFrame, table: str, cols: dict[str, str], pct_col: tuple[str, str]) -> DataFrame:
    """Q4-Q6: NULL counts of chosen columns plus one NULL share."""
    n = F.count(F.lit(1))
    aggs = [F.lit(table).alias("table_name"), n.alias("total_rows")]
    aggs += [(n - F.count(F.col(c))).alias(name) for c, name in cols.items()]
    src, name = pct_col
    aggs.append(pct(n - F.count(F.col(src)), n).alias(name))
    return df.agg(*aggs)


def nulls_collision(df: DataFrame) -> DataFrame:
    return null_report(df, "collision", {
        "longitude": "longitude_nulls", "latitude": "latitude_nulls", "weather_conditions": "weather_nulls",
        "light_conditions": "light_nulls", "road_surface_conditions": "road_surface_nulls"},
        ("longitude", "longitude_null_pct"))


def nulls_vehicle(df: DataFrame) -> DataFrame:
    return null_report(df, "vehicle", {"age_of_driver": "age_nulls", "vehicle_type": "vehicle_type_nulls"},
                       ("age_of_driver", "age_null_pct"))


def nulls_casualty(df: DataFrame) -> DataFrame:
    return null_report(df, "casualty", {"age_of_casualty": "age_nulls", "casualty_severity": "severity_nulls"},
                       ("age_of_casualty", "age_null_pct"))


def key_violations(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Q7: keys that occur more than once and the surplus rows they carry."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return per_key.agg(F.lit(table).alias("table_name"),
                       F.count(F.lit(1)).alias("duplicate_keys"),
                       F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("surplus_rows"))


def orphan_report(collision: DataFrame, vehicle: DataFrame, casualty: DataFrame) -> DataFrame:
    """Q7: foreign-key orphans, one row per relation."""
    parts = [
        orphans(vehicle, collision).agg(F.lit("vehicle->collision").alias("relation"),
                                        F.count(F.lit(1)).alias("orphan_rows")),
        orphans(casualty, collision).agg(F.lit("casualty->collision").alias("relation"),
                                         F.count(F.lit(1)).alias("orphan_rows")),
        orphans(casualty, vehicle, ("collision_index", "vehicle_reference")).agg(
            F.lit("casualty->vehicle").alias("relation"), F.count(F.lit(1)).alias("orphan_rows")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
