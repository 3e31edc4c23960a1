"""Sources/sinks, model persistence, the SQL table function and X2."""

import os
import tempfile

from pyspark.sql import functions as F

from crashlens.operators import cleaning, forecast, joins, ml, profiling, risk
from crashlens.plans import queries_ml
from crashlens.plans.queries import _hourly
from crashlens.plans.tables import Tables
from crashlens.sources import io, schemas
from crashlens.streaming import jobs


def _tmp():
    return tempfile.mkdtemp(prefix="crashlens-io-")


def test_csv_roundtrip_with_declared_schema(spark, sf):
    t = Tables(spark, sf)
    out = os.path.join(_tmp(), "collision_csv")
    io.write_csv(t.raw_collision, out)
    back = io.read_collisions(spark, out)
    assert io.reject_counts(back).count() == 0
    assert [f.name for f in back.schema.fields][:-1] == [f.name for f in schemas.COLLISION.fields]
    same = io.accepted(back)
    rows = lambda df: sorted(map(str, df.select(*same.columns).collect()))
    assert rows(same) == rows(t.raw_collision)


def test_csv_binds_by_header(spark):
    """Reordered, extra and missing columns, the published date names, and bad values."""
    path = os.path.join(_tmp(), "collision.csv")
    with open(path, "w") as f:
        f.write("collision_index, collision_severity,date,time,number_of_vehicles,longitude,location_easting\n"
                "A1,3,30/03/2025,01:30,2,-0.5,123\nA2,bad,31/02/2025,02:00,,NULLISH,\nA3,1,2025-04-01,23:59,1\n")
    df = io.read_collisions(spark, path)
    rows = {r.collision_index: r for r in df.collect()}
    assert (rows["A1"].collision_severity, str(rows["A1"].date_of_accident), rows["A1"].time_of_accident, rows["A1"].number_of_vehicles) == (3, "2025-03-30", "01:30", 2)
    assert rows["A1"].raw_date == "30/03/2025" and rows["A1"].location_easting == "123" and rows["A1"].speed_limit is None
    assert set(rows["A2"]["_rejects"]) == {"collision_severity", "date_of_accident", "longitude"} and rows["A1"]["_rejects"] == []
    assert rows["A3"].longitude is None and str(rows["A3"].date_of_accident) == "2025-04-01"
    assert {r.column_name: r.n for r in io.reject_counts(df).collect()} == {"collision_severity": 1, "date_of_accident": 1, "longitude": 1}
    assert io.accepted(df).count() == 2


def test_partitioned_parquet_prunes_by_month(spark, sf):
    t = Tables(spark, sf)
    out = os.path.join(_tmp(), "features")
    io.write_partitioned_by_month(t.features().drop("year", "month"), out)
    back = spark.read.parquet(out)
    assert back.count() == t.collision.count()
    plan = back.filter((F.col("year") == 1996) & (F.col("month") == 3))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_pipeline_model_save_load(spark, sf):
    m = queries_ml.labelled(spark, sf)
    model = ml.fit(m, "lr", queries_ml.feature_names(m), "row_id")
    path = os.path.join(_tmp(), "lr")
    ml.save_model(model, path, "lr", spark)
    again, kind = ml.load_model(path, spark)
    assert kind == "lr"
    a = ml.predict(model, m).select("row_id", "prediction")
    b = ml.predict(again, m).select("row_id", F.col("prediction").alias("p2"))
    assert a.join(b, "row_id").filter(F.col("prediction") != F.col("p2")).count() == 0


def test_forecast_coefficients_saved(spark, sf):
    path = os.path.join(_tmp(), "coef")
    forecast.save_coefficients(_hourly(spark, sf), path, "arima")
    coef = spark.read.parquet(path)
    assert coef.select("series_key").distinct().count() == _hourly(spark, sf).select("series_key").distinct().count()


def test_sql_table_function_equals_dataframe_form(spark, sf):
    f = Tables(spark, sf).features()
    f.createOrReplaceTempView("collision_with_features")
    risk.register_risk_function(spark)
    sql_row = spark.sql("SELECT * FROM get_risk_score(17, 5, 1, 1, NULL, 1)").collect()
    df_row = risk.risk_score(f, 17, 5, weather=1, light=1, urban_rural=1).collect()
    assert len(sql_row) == 1 and tuple(sql_row[0]) == tuple(df_row[0])


def test_request_stream_scored(spark, sf):
    f = Tables(spark, sf).features()
    req = risk.requests_from_collisions(f)
    base = _tmp()
    src = os.path.join(base, "req")
    req.write.parquet(src)
    stream = spark.readStream.schema(req.schema).parquet(src)
    cube = os.path.join(base, "cube")
    risk.risk_cube(f).write.parquet(cube)
    scored = jobs.score_requests_stream(stream, spark.read.parquet(cube))
    jobs.run_available_now(scored, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    out = spark.read.parquet(os.path.join(base, "out"))
    batch = risk.risk_score_batch(f, req)
    assert out.count() == batch.count()
    assert out.exceptAll(batch).count() == 0


def test_drop_all_null_and_unique_columns(spark, sf):
    t = Tables(spark, sf)
    d = cleaning.drop_all_null_columns(t.raw_collision)
    assert "local_authority_district" not in d.columns and "collision_index" in d.columns
    u = cleaning.drop_unique_columns(d)
    assert "collision_index" not in u.columns and "weather_conditions" in u.columns


def test_dtypes_table(spark, sf):
    rows = {r.data_type: r.number_of_columns for r in profiling.dtypes_table(Tables(spark, sf).collision).collect()}
    assert rows["int"] >= 10 and rows["object"] >= 4


def test_split_left_join_equals_plain_join(spark):
    """Missing, repeated and NULL keys on both sides, with and without null-safe keys."""
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4), (None, 5)], "k string, x int")
    right = spark.createDataFrame([("a", 10), ("a", 11), ("a", 12), ("c", 13), (None, 14), (None, 15), ("z", 16)], "k string, y int")
    got = joins.split_left_join(left, right, ["k"])
    assert sorted(got.collect(), key=str) == sorted(left.join(right, ["k"], "left").collect(), key=str)
    merged = joins.merge(left, right, ["k"], "left", "ind")
    safe = left.alias("l").join(right.alias("r"), F.col("l.k").eqNullSafe(F.col("r.k")), "left").select("l.k", "x", "y")
    assert sorted(merged.select("k", "x", "y").collect(), key=str) == sorted(safe.collect(), key=str)
    assert {(r.k, r.ind) for r in merged.collect()} == {("a", "both"), ("b", "left_only"), ("c", "both"), (None, "both")}
    assert joins.merge(left, right, ["k"], "inner").count() == 3 + 1 + 4


def test_split_left_join_with_a_hot_key(spark, sf):
    t = Tables(spark, sf)
    v = t.vehicle
    hot = v.select("collision_index").first()[0]
    extra = (v.limit(3000).withColumn("collision_index", F.lit(hot))
             .withColumn("vehicle_reference", F.concat(F.lit("h"), F.col("vehicle_id").cast("string"))))
    skewed = v.unionByName(extra).select("collision_index", *joins.VEHICLE_COLS)
    plain = t.features().join(skewed, ["collision_index"], "left")
    split = joins.split_left_join(t.features(), skewed, ["collision_index"])
    assert plain.count() == split.count()
    assert plain.select(*split.columns).exceptAll(split).count() == 0


def test_accident_join_is_inner_on_the_child_side(spark, sf):
    """Joins that AQE can split on either side; no job runs to build the plan."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Tables(spark, sf).full._jdf.queryExecution().executedPlan().toString()
        assert "LeftOuter" not in plan and "RightOuter" not in plan and "Inner" in plan and "LeftAnti" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_collisions_do_not_multiply_rows(spark, sf):
    t = Tables(spark, sf)
    t.__dict__["raw_collision"] = t.raw_collision_dup
    assert t.full.count() == Tables(spark, sf).full.count()
