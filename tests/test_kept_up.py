"""Constraints on writes, mergeable profiles, the risk cube in increments and the gap-filled stream."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from crashlens.operators import profiling, risk, series
from crashlens.plans.tables import Tables
from crashlens.sources import constraints
from crashlens.streaming import jobs


def _tables(spark):
    day, t = dt.date(2020, 1, 1), lambda h: dt.datetime(2020, 1, 1, h)
    collision = spark.createDataFrame(
        [("a", day, "10:00", t(2), 1), ("a", day, "10:00", t(1), 2), ("b", None, "10:00", t(1), 3), (None, day, None, t(1), 4), ("c", day, "11:00", None, 5),
         ("c", day, "11:00", None, 5)],
        "collision_index string, date_of_accident date, time_of_accident string, created_at timestamp, speed_limit int")
    vehicle = spark.createDataFrame(
        [(1, "a", "1", t(1)), (2, "a", "1", t(0)), (3, "b", "1", t(1)), (4, "z", "1", t(1)), (5, None, "1", t(1)), (6, "c", "1", t(1)), (7, "z", None, t(1))],
        "vehicle_id bigint, collision_index string, vehicle_reference string, created_at timestamp")
    casualty = spark.createDataFrame([(1, "a", "1", "1"), (2, "b", "1", "1")], "casualty_id bigint, collision_index string, vehicle_reference string, casualty_reference string")
    return {"casualty": casualty, "vehicle": vehicle, "collision": collision}


def test_every_declared_constraint_acts(spark):
    judged = constraints.judged_tables(_tables(spark))
    assert sorted((r.speed_limit, r._reasons) for r in judged["collision"].collect()) == [
        (1, ["unique:collision_index"]), (2, []), (3, ["not_null:date_of_accident"]), (4, ["not_null:collision_index", "not_null:time_of_accident"]),
        (5, []), (5, ["unique:collision_index"])]
    assert {r.vehicle_id: r._reasons for r in judged["vehicle"].collect()} == {
        1: ["unique:collision_index,vehicle_reference"], 2: [], 3: ["references:collision"], 4: ["references:collision"],
        5: ["not_null:collision_index"], 6: [], 7: ["not_null:vehicle_reference", "references:collision"]}
    # the parent with a NULL is in quarantine, so its child is as well; no created_at here
    assert {r.casualty_id: r._reasons for r in judged["casualty"].collect()} == {1: [], 2: ["references:collision"]}


def test_missing_column_counts_as_null_and_empty_tables_pass(spark):
    vehicle = spark.createDataFrame([("a",)], "collision_index string")
    empty = spark.createDataFrame([], "collision_index string, date_of_accident date, time_of_accident string")
    judged = constraints.judged_tables({"collision": empty, "vehicle": vehicle})
    assert judged["collision"].count() == 0
    assert judged["vehicle"].first()._reasons == ["not_null:vehicle_id", "not_null:vehicle_reference", "references:collision"]


def test_enforced_write_loses_no_row(spark, sf):
    t = Tables(spark, sf)
    folder = tempfile.mkdtemp(prefix="crashlens-enforced-")
    tables = {"collision": t.raw_collision_dup, "vehicle": t.raw_vehicle}
    constraints.write_enforced(tables, folder)
    for name, df in tables.items():
        good, bad = spark.read.parquet(f"{folder}/{name}"), spark.read.parquet(f"{folder}/{name}_quarantine")
        assert good.unionByName(bad.drop("_reasons")).exceptAll(df).count() == 0 and good.count() + bad.count() == df.count()
        assert good.groupBy(*constraints.declared(name).unique[0]).count().where("count > 1").isEmpty() and not bad.isEmpty()
    assert spark.read.parquet(f"{folder}/collision").count() == t.collision.count()


def test_describe_of_text_merges(spark):
    rows = [("x", True, 1), ("y", True, 2), ("y", None, 3), ("x", False, None), (None, None, 4)]
    schema = "a string, b boolean, n int"
    whole = spark.createDataFrame(rows, schema)
    got = {r.column_name: r for r in profiling.describe_all(whole).collect()}
    assert (got["a"]["count"], got["a"].unique, got["a"].top, got["a"].freq) == (4, 2, "x", 2)
    assert (got["b"]["count"], got["b"].unique, got["b"].top, got["b"].freq) == (3, 2, "true", 2)
    assert got["n"].top is None and got["n"].q50 == 2.5 and got["a"].q50 is None
    parts = [profiling.text_value_counts(spark.createDataFrame(p, schema)) for p in (rows[:2], rows[2:])]
    merged = profiling.describe_text(profiling.merged_counts(*parts))
    assert merged.exceptAll(profiling.describe_text(profiling.text_value_counts(whole))).isEmpty()
    none = profiling.describe_text(profiling.text_value_counts(spark.createDataFrame([(None,)], "a string"))).first()
    assert (none["count"], none.unique, none.top, none.freq) == (0, 0, None, None)


def test_cube_after_two_increments_is_the_cube_of_all(spark, sf):
    f = Tables(spark, sf).features()
    part = F.pmod(F.xxhash64("collision_index"), F.lit(3))  # days fall into several increments
    state = risk.cube_state(f.where(part == 0))
    for i in (1, 2):
        state = risk.add_to_state(state, risk.cube_state(f.where(part == i)))
    whole, names = risk.cube_state(f), risk.cube_state(f).columns
    assert state.select(names).exceptAll(whole).isEmpty() and state.count() == whole.count()
    cube, names = risk.risk_cube(f), risk.risk_cube(f).columns
    kept = risk.cube_of_state(state).select(names)
    assert kept.exceptAll(cube).isEmpty() and cube.exceptAll(kept).isEmpty()


def _event(spark, folder, name, rows):
    rows = [(i, dt.datetime(2024, 3, 1) + dt.timedelta(hours=h), 1, kind, 1.0, None) for i, (kind, h) in enumerate(rows)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(os.path.join(folder, name))


def test_gap_filled_stream_equals_batch(spark):
    """Gaps inside a batch and across runs, rows late within the delay, and a row too late."""
    base = tempfile.mkdtemp(prefix="crashlens-gaps-")
    src, sink, ckpt = (os.path.join(base, x) for x in ("src", "sink", "ckpt"))
    runs = [[("a", 0.5), ("a", 0.7), ("b", 1.5), ("a", 4.2), ("a", 9.0)], [("a", 8.5), ("b", 12.1), ("a", 14.9)], [("a", 1.0), ("a", 40.0), ("b", 41.5)], [("b", 60.0)]]
    for i, rows in enumerate(runs):
        _event(spark, src, f"part={i}", rows)
        stream = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").parquet(f"{src}/part=*")
        jobs.run_available_now(jobs.hourly_series_stream(stream), sink, ckpt)
    told = {(r.series_key, r.ts): r.y for r in spark.read.parquet(sink).collect()}
    assert spark.read.parquet(sink).count() == len(told)
    in_time = spark.read.parquet(f"{src}/part=*").where("NOT (event_type = 'a' AND ts = TIMESTAMP_NTZ '2024-03-01 01:00:00')")
    batch = {(r.series_key, r.ts): r.y for r in series.hourly_series(in_time, "ts", "event_type", also_all=True).collect()}
    last = {}
    for key, ts in told:
        last[key] = max(ts, last.get(key, ts))
    assert told == {k: y for k, y in batch.items() if k[1] <= last[k[0]]}
    assert last["ALL"] >= dt.datetime(2024, 3, 2, 17) and sum(y == 0 for y in told.values()) > 30
