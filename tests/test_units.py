"""Hand-made rows for edge cases of the operators."""

import datetime as dt

from pyspark.sql import functions as F

from crashlens.operators import cleaning, features, joins, quality, risk, series
from crashlens.operators.series import forecast_metrics


def _coll(spark, rows):
    """rows: (collision_index, date, time, weather, light, surface, speed, severity)."""
    base = spark.createDataFrame(rows, "collision_index string, date_of_accident date, time_of_accident string, "
                                       "weather_conditions int, light_conditions int, road_surface_conditions int, "
                                       "speed_limit int, collision_severity int")
    return base.select("*", F.lit(1).alias("road_type"), F.lit(1).alias("urban_or_rural_area"),
                       F.lit(1).alias("number_of_casualties"), F.lit(1).alias("number_of_vehicles"))


def test_time_period_and_slots(spark):
    times = ["06:59", "07:00", "09:59", "10:00", "14:59", "15:00", "18:59", "19:00", "22:00", "03:00", "00:14",
             "00:15", "23:59"]
    rows = [(str(i), dt.date(2025, 1, 3), t, 1, 1, 1, 30, 3) for i, t in enumerate(times)]
    f = features.with_features(_coll(spark, rows))
    got = {r.time_of_accident: (r.time_period, r.time_slot_15min) for r in f.collect()}
    assert got["06:59"][0] == "Off-Peak" and got["07:00"][0] == "Morning Rush" and got["09:59"][0] == "Morning Rush"
    assert got["15:00"][0] == "Evening Rush" and got["18:59"][0] == "Evening Rush" and got["22:00"][0] == "Off-Peak"
    assert got["00:14"][1] == 0 and got["00:15"][1] == 1 and got["23:59"][1] == 95
    w = {r.time_of_accident: r.time_period for r in features.with_features(_coll(spark, rows), "wrap").collect()}
    assert w["22:00"] == "Night" and w["03:00"] == "Night" and w["06:59"] == "Night"


def test_weekday_and_weekend(spark):
    rows = [("1", dt.date(2025, 1, 5), "10:00", 1, 1, 1, 30, 3), ("2", dt.date(2025, 1, 4), "10:00", 1, 1, 1, 30, 3),
            ("3", dt.date(2025, 1, 3), "10:00", 1, 1, 1, 30, 3)]
    got = {r.collision_index: (r.day_of_week, r.is_weekend, r.day_name)
           for r in features.with_features(_coll(spark, rows)).collect()}
    assert got == {"1": (0, True, "Sunday"), "2": (6, True, "Saturday"), "3": (5, False, "Friday")}


def test_codes_after_cleaning(spark):
    rows = [(str(i), dt.date(2025, 1, 3), "10:00", w, 1, 1, 30, 3) for i, w in enumerate([-1, 99, 8, 9])]
    f = features.with_features(cleaning.clean_collision(_coll(spark, rows))).orderBy("collision_index")
    got = [(r.weather_conditions, r.weather_label) for r in f.collect()]
    assert got == [(None, "Unknown"), (None, "Unknown"), (8, "Other"), (9, "Unknown")]


def test_risk_scores(spark):
    rows = [("1", dt.date(2025, 1, 4), "22:00", 2, 4, 2, 60, 1), ("2", dt.date(2025, 1, 3), "10:00", None, None, None,
                                                                  None, 3)]
    got = {r.collision_index: (r.total_risk_score, r.risk_level)
           for r in features.collision_risk_scores(features.with_features(_coll(spark, rows))).collect()}
    assert got == {"1": (5, "High Risk"), "2": (0, "Low Risk")}


def test_risk_lookup_empty_and_batch_equals_point(spark):
    rows = [(str(i), dt.date(2025, 1, 3 + (i % 2) * 7), "17:10", 2, 4, 2, 30, 1 + i % 3) for i in range(6)]
    f = features.with_features(_coll(spark, rows))
    empty = risk.risk_score(f, 3, 1).collect()
    assert len(empty) == 1
    assert tuple(empty[0]) == ("LOW", None, None, "Low risk period for travel.")
    point = risk.risk_score(f, 17, 5, weather=2, light=None).collect()[0]
    req = spark.createDataFrame([(1, 17, 5, 2, None, None, None), (2, 3, 1, None, None, None, None)],
                                "request_id long, hour int, day_of_week int, weather int, light int, "
                                "road_surface int, urban_rural int")
    batch = {r.request_id: r for r in risk.risk_score_batch(f, req).collect()}
    assert tuple(batch[1])[1:] == tuple(point)
    assert tuple(batch[2])[1:] == ("LOW", None, None, "Low risk period for travel.")
    assert point.expected_accidents == 3.0 and point.predicted_risk_level == "LOW"


def test_dedup_keeps_earliest_then_tiebreak(spark):
    t0, t1 = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
    df = spark.createDataFrame([("a", "1", 5, t1), ("a", "1", 9, t0), ("b", "1", 7, t0), ("b", "1", 3, t0)],
                               "collision_index string, vehicle_reference string, vehicle_type int, "
                               "created_at timestamp_ntz")
    got = {r.collision_index: r.vehicle_type for r in cleaning.dedup_vehicles(df).collect()}
    assert got == {"a": 9, "b": 3}


def test_joins_reach_casualties_through_vehicles(spark):
    c = _coll(spark, [("1", dt.date(2025, 1, 3), "10:00", 1, 1, 1, 30, 3),
                      ("2", dt.date(2025, 1, 3), "10:00", 1, 1, 1, 30, 3)])
    f = features.with_features(c)
    v = spark.createDataFrame([(10, "1", "1", 9)], "vehicle_id long, collision_index string, "
                                                   "vehicle_reference string, vehicle_type int")
    for col_name in ("vehicle_manoeuvre", "sex_of_driver", "age_of_driver", "driver_imd_decile"):
        v = v.withColumn(col_name, F.lit(None).cast("int"))
    v = v.withColumn("age_band_of_driver", F.lit(None).cast("string"))
    k = spark.createDataFrame([(1, "1", "2", "1", 2, 30, 1)],
                              "casualty_id long, collision_index string, vehicle_reference string, "
                              "casualty_reference string, casualty_severity int, age_of_casualty int, "
                              "sex_of_casualty int")
    full = joins.full_accident_data(f, v, k).collect()
    assert len(full) == 2  # accident without vehicle kept; casualty of a missing vehicle not reached
    assert all(r.casualty_id is None for r in full)
    rows = joins.casualty_training_rows(k, c, v).collect()
    assert len(rows) == 1 and rows[0].vehicle_type is None


def test_windows_and_series(spark):
    days = [dt.date(2025, 1, d) for d in range(1, 9) for _ in range(d)]
    c = spark.createDataFrame([(str(i), d, 1) for i, d in enumerate(days)],
                              "collision_index string, date_of_accident date, number_of_casualties int")
    ff = {r.date_of_accident.day: r for r in series.forecast_features(c).collect()}
    assert ff[1].lag_1day is None and ff[1].rolling_7day_stddev is None
    assert ff[8].rolling_7day_mean == 4.0 and abs(ff[8].rolling_7day_stddev - 2.160247) < 1e-6
    ev = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 10),), (dt.datetime(2024, 1, 1, 3, 20),)],
                               "ts timestamp_ntz")
    hs = [r.y for r in series.hourly_series(ev).orderBy("ts").collect()]
    assert hs == [1, 0, 0, 1]


def test_mape_plus_one(spark):
    p = spark.createDataFrame([("A", "m", 0.0, 1.0)], "series_key string, model string, y double, yhat double")
    r = forecast_metrics(p).collect()[0]
    assert r.mape == 100.0 and r.mae == 1.0


def test_bad_dates_dropped(spark):
    df = spark.createDataFrame([("13/01/2025", "10:00"), ("31/02/2025", "10:00"), (None, "10:00")],
                               "raw_date string, raw_time string")
    assert cleaning.parse_datetime(df).count() == 1


def test_exact_quantiles_match_percentile_across_partitions(spark, sf):
    from crashlens.operators.quantiles import quantile_columns, quantiles, value_counts
    from crashlens.plans.tables import Tables

    c = Tables(spark, sf).raw_collision.withColumn("none", F.lit(None).cast("double"))
    cols = ["longitude", "latitude", "speed_limit", "none"]
    probs = [0.0, 0.25, 0.5, 0.75, 1.0, 0.333]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = value_counts(c, cols, "police_force", with_all=True)
        got = {(r.feature, r.group_value): [round(v, 9) for v in r.q] for r in quantiles(counts, probs).collect()}
        wide = quantile_columns(c, cols, [0.25, 0.5, 0.75]).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for name in cols[:3]:
        per = F.percentile(F.col(name).cast("double"), probs).alias("q")
        for r in c.groupBy(F.col("police_force").cast("string").alias("g")).agg(per).collect() + c.agg(F.lit("ALL").alias("g"), per).collect():
            if r.g is not None and r.q is not None:
                want[name, r.g] = [round(v, 9) for v in r.q]
    assert got == want
    exp = c.agg(*[F.percentile(F.col(k).cast("double"), [0.25, 0.5, 0.75]).alias(f"q{i}") for i, k in enumerate(cols)]).first()
    assert [wide[f"q{i}"] and list(wide[f"q{i}"]) for i in range(4)] == [exp[f"q{i}"] and list(exp[f"q{i}"]) for i in range(4)]


def test_box_plots_and_outliers_use_counted_values(spark, sf):
    """One run of the input, and no exchange of raw rows by (feature, group)."""
    from crashlens.operators import profiling
    from crashlens.plans.tables import Tables

    c = Tables(spark, sf).raw_collision
    for df in (profiling.boxplot_stats(c, ["speed_limit", "longitude"], "police_force"), profiling.iqr_outliers(c.select("speed_limit", "longitude"))):
        assert "parquet" not in df._jdf.queryExecution().executedPlan().toString()
    x = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 3, 3, 4, 4, 50]], "x double")
    r = profiling.boxplot_stats(x, ["x"]).first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_long_ids_are_told_apart(spark):
    from crashlens.operators import profiling

    df = spark.createDataFrame([(2 ** 53 + i, None) for i in range(4)], "id long, empty string")
    rows = {r.column_name: (r.n_unique, r.n_missing) for r in profiling.feature_overview(df).collect()}
    assert rows == {"id": (4, 0), "empty": (0, 4)}


def test_times_with_seconds_and_missing_times(spark):
    df = spark.createDataFrame([("00:00:00",), ("23:59:59",), (None,), ("12:30",), ("24:00",), ("7:05",)], "time_of_accident string")
    assert quality.invalid_time(df).first().invalid_time_count == 2


def test_session_zone_does_not_matter(spark):
    """Local hours that a zone skips or repeats stay as written."""
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        df = spark.createDataFrame([("30/03/2025", "01:30"), ("30/03/2025", "02:30"), ("26/10/2025", "01:30")], "raw_date string, raw_time string")
        parsed = cleaning.parse_datetime(df)
        assert [str(r.datetime) for r in parsed.orderBy("datetime").collect()] == ["2025-03-30 01:30:00", "2025-03-30 02:30:00", "2025-10-26 01:30:00"]
        hours = series.counts_per_period(parsed, "datetime", "hour").orderBy("ts").collect()
        assert [(str(r.ts), r.y) for r in hours] == [("2025-03-30 01:00:00", 1), ("2025-03-30 02:00:00", 1), ("2025-10-26 01:00:00", 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_calendar_trend_sees_gaps(spark):
    from datetime import date, timedelta

    from crashlens.operators import series

    days = {0: 2, 1: 1, 9: 4, 30: 3, 31: 1}
    rows = [(date(2024, 1, 1) + timedelta(days=d), 1) for d, n in days.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "date_of_accident date, number_of_casualties int")
    got = {(r["date_of_accident"] - date(2024, 1, 1)).days: r for r in series.daily_trend_rolling(df, calendar=True).collect()}
    assert got[1]["rolling_7day_avg"] == 1.5 and got[9]["rolling_7day_avg"] == 4.0 and got[31]["rolling_7day_max"] == 3
    assert got[30]["accidents_30days_ago"] == 2 and got[31]["month_change"] == 0 and got[9]["accidents_30days_ago"] is None


def test_repeated_rows_are_counted_by_all_columns(spark):
    """Rows that share a hash without being equal (NULLs in other places) are told apart, and only
    rows with a repeated hash are shuffled whole."""
    from crashlens.operators import profiling

    rows = [("a", None), (None, "a"), ("a", "a"), (None, None), (None, None), ("b", "c"), ("b", "c"), ("b", "c")]
    df = spark.createDataFrame(rows, "x string, `y z` string")
    found = profiling.duplicate_row_count(df)
    assert found.first().duplicate_rows == 3 and "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()
    assert profiling.duplicate_row_count(df.limit(0)).first().duplicate_rows == 0
