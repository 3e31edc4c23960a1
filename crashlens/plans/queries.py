"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Every query reads the driver tables through the fixture mapping and runs
the operators on the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.operators import (cleaning, features, joins, profiling, quality, risk, series, stats)
from crashlens.plans.tables import TRAINING_FEATURES, Tables
from crashlens.sources import constraints

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# registered parameters (function defaults keep the reference's values)
FUTURE_AS_OF = "2001-01-01"
HIGH_RISK_PERIOD_THRESHOLD = 100
CUBE_SPLIT = "1995-06-17"
RISK_POINT = dict(hour=17, day_of_week=5, weather=1, light=1, road_surface=None, urban_rural=1)
CORR_COLS = ("hour_of_day", "day_of_week", "month", "time_slot_15min", "weather_conditions", "light_conditions",
             "road_surface_conditions", "speed_limit", "number_of_vehicles", "number_of_casualties")
NB_NUMERIC_PROFILE = ("number_of_vehicles", "number_of_casualties", "speed_limit", "age_of_driver",
                      "age_of_casualty", "hour", "time_slot_15min")


def q(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def T(spark, sf) -> Tables:
    return Tables(spark, sf)


# ---- cleaning --------------------------------------------------------------
@q("clean_collision")
def _(spark, sf):
    return T(spark, sf).collision


@q("clean_vehicle")
def _(spark, sf):
    return cleaning.clean_vehicle(T(spark, sf).raw_vehicle)


@q("clean_casualty")
def _(spark, sf):
    return cleaning.clean_casualty(T(spark, sf).raw_casualty)


@q("clean_numeric_minus1")
def _(spark, sf):
    return cleaning.numeric_sentinel_to_null(T(spark, sf).raw_vehicle, -1)


@q("clean_global_sentinels")
def _(spark, sf):
    return cleaning.global_sentinels_to_null(T(spark, sf).nb_merged)


@q("clean_ids")
def _(spark, sf):
    t = T(spark, sf)
    return cleaning.add_source_tag(cleaning.ids_to_trimmed_string(t.raw_casualty), "casualty")


@q("drop_exact_duplicates")
def _(spark, sf):
    t = T(spark, sf)
    return cleaning.drop_exact_duplicates(t.raw_vehicle.drop("vehicle_id"))


@q("dedup_vehicles")
def _(spark, sf):
    return T(spark, sf).vehicle


@q("dedup_casualties")
def _(spark, sf):
    return T(spark, sf).casualty


@q("dedup_collisions")
def _(spark, sf):
    return cleaning.dedup_collisions(T(spark, sf).raw_collision_dup)


@q("median_impute")
def _(spark, sf):
    t = T(spark, sf)
    return cleaning.median_impute(t.raw_vehicle.select("vehicle_id", "age_of_driver", "sex_of_driver",
                                                       "driver_imd_decile"),
                                  ["age_of_driver", "sex_of_driver", "driver_imd_decile"])


@q("parse_datetime")
def _(spark, sf):
    t = T(spark, sf)
    return cleaning.parse_datetime(t.raw_collision.select("collision_index", "raw_date", "raw_time"))


@q("encode_target")
def _(spark, sf):
    rows = T(spark, sf).training_rows
    return cleaning.encode_target(rows).select("collision_index", "vehicle_reference", "casualty_reference",
                                               "casualty_severity", "label")


# ---- quality ---------------------------------------------------------------
@q("dq_future_dates")
def _(spark, sf):
    return quality.future_dates(T(spark, sf).collision, FUTURE_AS_OF)


@q("dq_invalid_time")
def _(spark, sf):
    return quality.invalid_time(T(spark, sf).raw_collision, "raw_time")


@q("dq_invalid_severity")
def _(spark, sf):
    return quality.invalid_severity(T(spark, sf).collision)


@q("dq_nulls_collision")
def _(spark, sf):
    return quality.nulls_collision(T(spark, sf).collision)


@q("dq_nulls_vehicle")
def _(spark, sf):
    return quality.nulls_vehicle(T(spark, sf).vehicle)


@q("dq_nulls_casualty")
def _(spark, sf):
    return quality.nulls_casualty(T(spark, sf).casualty)


@q("dq_key_violations")
def _(spark, sf):
    t = T(spark, sf)
    return (quality.key_violations(t.raw_collision_dup, "collision", cleaning.COLLISION_KEY)
            .unionByName(quality.key_violations(t.raw_vehicle, "vehicle", cleaning.VEHICLE_KEY))
            .unionByName(quality.key_violations(t.raw_casualty, "casualty", cleaning.CASUALTY_KEY)))


@q("dq_orphans")
def _(spark, sf):
    t = T(spark, sf)
    return quality.orphan_report(t.keys("collision"), t.keys("vehicle"), t.keys("casualty"))


@q("drop_orphans")
def _(spark, sf):
    t = T(spark, sf)
    return joins.semi(t.vehicle_rows, t.keys("collision"))


# ---- profiling -------------------------------------------------------------
@q("profile_missing_pct")
def _(spark, sf):
    return profiling.missing_pct(T(spark, sf).collision)


@q("profile_minus1")
def _(spark, sf):
    return profiling.minus_one_counts(T(spark, sf).raw_collision)


@q("profile_describe")
def _(spark, sf):
    return profiling.describe_numeric(T(spark, sf).raw_collision)


@q("profile_describe_all")
def _(spark, sf):
    return profiling.describe_all(T(spark, sf).raw_collision)


@q("constraint_violations")
def _(spark, sf):
    t = T(spark, sf)
    tables = {"collision": t.raw_collision_dup, "vehicle": t.raw_vehicle, "casualty": t.raw_casualty}
    return constraints.violation_counts(constraints.judged_tables(tables, whole=False))


@q("feature_overview")
def _(spark, sf):
    return profiling.feature_overview(T(spark, sf).nb_full)


@q("duplicate_row_count")
def _(spark, sf):
    return profiling.duplicate_row_count(T(spark, sf).nb_full)


@q("iqr_outliers")
def _(spark, sf):
    return profiling.iqr_outliers(T(spark, sf).nb_full.select(*NB_NUMERIC_PROFILE))


@q("merge_entity_counts")
def _(spark, sf):
    return profiling.merge_entity_counts(T(spark, sf).nb_merged)


@q("correlation_pairs")
def _(spark, sf):
    return profiling.correlation_pairs(features.ml_training_dataset(T(spark, sf).features()), CORR_COLS)


# ---- features --------------------------------------------------------------
@q("collision_with_features")
def _(spark, sf):
    return T(spark, sf).features()


@q("label_notebook")
def _(spark, sf):
    return features.label_notebook(T(spark, sf).nb_collision)


@q("collision_risk_scores")
def _(spark, sf):
    return features.collision_risk_scores(T(spark, sf).features())


@q("notebook_time_features")
def _(spark, sf):
    t = T(spark, sf)
    return features.notebook_time_features(cleaning.parse_datetime(
        t.raw_collision.select("collision_index", "raw_date", "raw_time")))


@q("engineered_features")
def _(spark, sf):
    return features.engineered_features(T(spark, sf).features())


@q("iqr_cap")
def _(spark, sf):
    from crashlens.functions.expr import attach_one_row
    f = T(spark, sf).features().select("collision_index", "number_of_casualties", "number_of_vehicles")
    cols = ["number_of_casualties", "number_of_vehicles"]
    from crashlens.operators.quantiles import quantile_columns
    qs = quantile_columns(f, cols, [0.25, 0.75]).toDF(*[f"__q_{c}" for c in cols])
    out = [F.col("collision_index")]
    for c in cols:
        qq = F.col(f"__q_{c}")
        iqr = qq[1] - qq[0]
        out.append(F.least(F.greatest(F.col(c).cast("double"), qq[0] - 1.5 * iqr), qq[1] + 1.5 * iqr).alias(c))
    return attach_one_row(f, qs).select(*out)


@q("ml_training_dataset")
def _(spark, sf):
    return features.ml_training_dataset(T(spark, sf).features())


# ---- statistics ------------------------------------------------------------
@q("hourly_accident_stats")
def _(spark, sf):
    return stats.hourly_accident_stats(T(spark, sf).features())


@q("daily_accident_stats")
def _(spark, sf):
    return stats.daily_accident_stats(T(spark, sf).features())


@q("monthly_accident_trends")
def _(spark, sf):
    return stats.monthly_accident_trends(T(spark, sf).features())


@q("peak_hours_top5")
def _(spark, sf):
    return stats.peak_hours(T(spark, sf).features(), 5)


@q("slot_15min_stats")
def _(spark, sf):
    return stats.slot_15min_stats(T(spark, sf).features())


@q("time_period_comparison")
def _(spark, sf):
    return stats.time_period_comparison(T(spark, sf).features("literal"))


@q("time_period_comparison_wrap")
def _(spark, sf):
    return stats.time_period_comparison(T(spark, sf).features("wrap"))


@q("weekend_vs_weekday")
def _(spark, sf):
    return stats.weekend_vs_weekday(T(spark, sf).features())


@q("seasonal_trends")
def _(spark, sf):
    return stats.seasonal_trends(T(spark, sf).features())


@q("high_risk_windows")
def _(spark, sf):
    return stats.high_risk_windows(T(spark, sf).features())


@q("rush_hour_severity")
def _(spark, sf):
    return stats.rush_hour_severity(T(spark, sf).features())


@q("high_risk_periods")
def _(spark, sf):
    return stats.high_risk_periods(T(spark, sf).features(), HIGH_RISK_PERIOD_THRESHOLD)


# ---- joins -----------------------------------------------------------------
@q("full_accident_data")
def _(spark, sf):
    return T(spark, sf).full


@q("merge_with_indicator")
def _(spark, sf):
    return T(spark, sf).nb_merged


@q("casualty_training_rows")
def _(spark, sf):
    return T(spark, sf).training_rows.select(
        "collision_index", "vehicle_reference", "casualty_reference", "casualty_severity",
        *[c for c in TRAINING_FEATURES if c in T(spark, sf).training_rows.columns and c != "casualty_severity"])


# ---- risk ------------------------------------------------------------------
@q("hourly_risk_heatmap")
def _(spark, sf):
    return risk.hourly_risk_heatmap(T(spark, sf).features())


@q("environment_risk_matrix")
def _(spark, sf):
    return risk.environment_risk_matrix(T(spark, sf).features())


@q("vehicle_type_profile")
def _(spark, sf):
    return risk.vehicle_type_profile(T(spark, sf).full)


@q("top_risk_scenarios")
def _(spark, sf):
    return risk.top_risk_scenarios(T(spark, sf).features())


@q("risk_score_point")
def _(spark, sf):
    return risk.risk_score(T(spark, sf).features(), **RISK_POINT)


@q("risk_score_batch")
def _(spark, sf):
    f = T(spark, sf).features()
    return risk.risk_score_batch(f, risk.requests_from_collisions(f))


@q("risk_score_incremental")
def _(spark, sf):
    """U2 from a cube that was kept up to date: the accidents before a day, then the others."""
    f = T(spark, sf).features()
    early = F.coalesce(F.col("date_of_accident") < F.lit(CUBE_SPLIT).cast("date"), F.lit(False))
    state = risk.add_to_state(risk.cube_state(f.where(early)), risk.cube_state(f.where(~early)))
    return risk.score_requests(risk.cube_of_state(state), risk.requests_from_collisions(f))


# ---- notebook EDA tables ---------------------------------------------------
@q("categorical_frequencies")
def _(spark, sf):
    return profiling.categorical_frequencies(
        T(spark, sf).nb_full,
        list(profiling.CATEGORICAL_FEATURES) + ["casualty_severity_label", "time_slot_15min", "hour"])


@q("severity_by_hour")
def _(spark, sf):
    return profiling.severity_by_hour(T(spark, sf).nb_full)


@q("weekday_counts")
def _(spark, sf):
    return profiling.weekday_counts(T(spark, sf).nb_full)


@q("month_counts")
def _(spark, sf):
    return profiling.month_counts(T(spark, sf).nb_full)


@q("severity_by_category")
def _(spark, sf):
    return profiling.severity_by_category(T(spark, sf).nb_full, profiling.CATEGORICAL_FEATURES)


@q("histogram_casualties")
def _(spark, sf):
    return profiling.histogram(T(spark, sf).nb_full, "number_of_casualties", 30)


@q("boxplot_by_severity")
def _(spark, sf):
    full = T(spark, sf).nb_full
    cols = ["number_of_vehicles", "number_of_casualties"]
    return profiling.boxplot_stats(full, cols, "casualty_severity_label", with_all=True)


# ---- series ----------------------------------------------------------------
def _hourly(spark, sf) -> DataFrame:
    return series.hourly_series(T(spark, sf).events, "ts", "event_type", also_all=True)


def _daily(spark, sf) -> DataFrame:
    c = T(spark, sf).collision
    return series.daily_series(c, series.parsed_day("raw_date"))


@q("hourly_series")
def _(spark, sf):
    return _hourly(spark, sf)


@q("daily_series")
def _(spark, sf):
    return _daily(spark, sf)


@q("hourly_profile")
def _(spark, sf):
    return series.hourly_profile(_hourly(spark, sf))


@q("peak_hours_top3")
def _(spark, sf):
    return series.peak_hours_top(_hourly(spark, sf), 3)


@q("series_summary")
def _(spark, sf):
    return (series.series_summary(_hourly(spark, sf)).withColumn("frequency", F.lit("hourly"))
            .unionByName(series.series_summary(_daily(spark, sf)).withColumn("frequency", F.lit("daily"))))


@q("daily_trend_rolling")
def _(spark, sf):
    return series.daily_trend_rolling(T(spark, sf).collision)


@q("daily_trend_calendar")
def _(spark, sf):
    return series.daily_trend_rolling(T(spark, sf).collision, calendar=True)


@q("forecast_features")
def _(spark, sf):
    return series.forecast_features(T(spark, sf).collision)


@q("rolling_mean_full")
def _(spark, sf):
    return series.rolling_mean_full(_daily(spark, sf), 7)


@q("supervised_sequences")
def _(spark, sf):
    s = series.supervised_sequences(_hourly(spark, sf), 24)
    return s.select("series_key", "ts", F.array_join(F.col("x").cast("array<string>"), ",").alias("x_values"), "y")


@q("minmax_scaled")
def _(spark, sf):
    return series.minmax_scaled(_hourly(spark, sf))


@q("forecast_metrics")
def _(spark, sf):
    return series.forecast_metrics(series.naive_predictions(_hourly(spark, sf)))


@q("ma_baseline_metrics")
def _(spark, sf):
    return series.ma_baseline_metrics(_hourly(spark, sf), 168, 720)
