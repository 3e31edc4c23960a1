"""Cleaned tables are written once per session, bucketed by the collision's key."""

import shutil

import pytest

from crashlens.plans import tables
from crashlens.plans.queries import QUERIES

STATISTICS = ("hourly_accident_stats", "daily_accident_stats", "time_period_comparison", "seasonal_trends", "high_risk_windows",
              "hourly_risk_heatmap", "environment_risk_matrix", "top_risk_scenarios", "daily_trend_rolling")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", STATISTICS)
def test_statistics_read_the_kept_table(spark, sf, key):
    plan = plan_of(QUERIES[key](spark, sf))
    assert "SortAggregate" not in plan and plan.count("FileScan") == plan.count("collision-")
    read = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert read and all("longitude" not in line and "created_at" not in line for line in read)


def test_accident_join_without_exchange(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        full = tables.Tables(spark, sf).full
        plan = plan_of(full.select("collision_index", "vehicle_id"))
        assert "FileScan" in plan and "Bucketed: true" in plan
        # the vehicle join reads buckets on both sides
        collisions, vehicles = tables.Tables(spark, sf).collision, tables.Tables(spark, sf).vehicle
        assert "Exchange" not in plan_of(collisions.join(vehicles, "collision_index").select("vehicle_reference"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_kept_tables_are_written_once_and_forgotten(spark, sf, tmp_path):
    for name in ("orders", "lineitem"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path)
    first = tables.Tables(spark, str(tmp_path)).collision
    assert tables.Tables(spark, str(tmp_path)).collision is first
    before = first.count()
    spark.read.parquet(f"{sf}/orders.parquet").limit(10).write.parquet(f"{tmp_path}/fewer")
    shutil.rmtree(tmp_path / "orders.parquet", ignore_errors=True)
    tables.forget(str(tmp_path))
    assert not [k for k in tables.KEPT if k[1] == str(tmp_path)] and before == first.count()


def test_one_row_per_key(spark, sf):
    t = tables.Tables(spark, sf)
    assert t.collision.count() == t.collision.select("collision_index").distinct().count()
    assert t.vehicle.count() == t.vehicle.select("collision_index", "vehicle_reference").distinct().count()


def test_a_repeated_collision_does_not_multiply_training_rows(spark, sf, monkeypatch):
    t = tables.Tables(spark, sf)
    expected = t._training_rows().count()
    again = tables.Tables(spark, sf)
    raw = again.raw_collision
    again.__dict__["raw_collision"] = raw.unionByName(raw)
    assert again._training_rows().count() == expected


def test_merges_by_accident_equal_merges_by_key(spark):
    """Also with NULL and empty ids on both sides, repeated keys and rows without a partner."""
    from crashlens.operators import cleaning, joins

    left = spark.createDataFrame([("1", "1", 10), ("1", "1", 11), ("1", None, 12), (None, "1", 13), ("", "1", 14), ("2", "1", 15), (None, None, 16)],
                                 "collision_index string, vehicle_reference string, a int")
    right = spark.createDataFrame([("1", "1", 20), ("1", "1", 21), ("1", None, 22), (None, "1", 23), ("", "1", 24), ("3", "1", 25), (None, None, 26)],
                                  "collision_index string, vehicle_reference string, b int")
    for on in (["collision_index"], ["collision_index", "vehicle_reference"]):
        want = joins.merge(left, right, on, "left", "ind")
        got = joins.merge(cleaning.by_accident(left), cleaning.by_accident(right), on, "left", "ind").drop(cleaning.ACCIDENT)
        rows = lambda df: sorted(map(str, df.select(*want.columns).collect()))
        assert rows(got) == rows(want)


def test_each_table_is_dealt_once(spark, sf):
    """Dedup, both merges and the write use one exchange of each table's rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = tables.Tables(spark, sf)
        for df in (t._training_rows(), t._nb_full()):
            assert plan_of(df).count("Exchange") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dedup_inside_the_buckets(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from crashlens.operators import cleaning
    from crashlens.session import stored_by_key

    raw = tables.Tables(spark, sf).raw_vehicle
    raw = raw.unionByName(raw.limit(50)).unionByName(raw.limit(20).withColumn("collision_index", F.lit(None).cast("string")))
    kept = stored_by_key(raw, "test_vehicle", "collision_index", cleaning.dedup_vehicles)
    want = cleaning.dedup_vehicles(raw)
    assert kept.count() == want.count() and kept.exceptAll(want).count() == 0
