"""Query key -> Spark callable, and query key -> oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from crashlens.plans import oracle, oracle_queries
from crashlens.plans.queries import QUERIES

# Result order of the published queries (O2); a minus sign means descending, and the
# names after it break ties.  Their rows are groups, so the sort is of a small result.
RESULT_ORDER = {
    "hourly_accident_stats": ("hour_of_day",),
    "daily_accident_stats": ("day_of_week",),
    "monthly_accident_trends": ("year", "month"),
    "daily_trend_rolling": ("date_of_accident",),
    "daily_trend_calendar": ("date_of_accident",),
    "slot_15min_stats": ("time_slot_15min",),
    "time_period_comparison": ("-accident_count", "time_period"),
    "time_period_comparison_wrap": ("-accident_count", "time_period"),
    "weekend_vs_weekday": ("day_type",),
    "seasonal_trends": ("month",),
    "forecast_features": ("date_of_accident",),
    "hourly_risk_heatmap": ("day_of_week", "hour_of_day"),
    "environment_risk_matrix": ("-accident_count", "weather_label", "light_label", "road_surface_label"),
    "vehicle_type_profile": ("-composite_risk_score", "vehicle_type_label"),
    "profile_missing_pct": ("-missing_pct", "column_name"),
    "profile_minus1": ("-minus1_count", "column_name"),
    "categorical_frequencies": ("feature", "-n", "value"),
}


def _ordered(query, names):
    def run(spark, sf_dir):
        order = [F.desc_nulls_last(n[1:]) if n[0] == "-" else F.asc(n) for n in names]
        return query(spark, sf_dir).orderBy(*order)

    return run


def queries():
    # make sure every module that registers queries is imported
    from crashlens.plans import queries_ml  # noqa: F401
    return {k: _ordered(f, RESULT_ORDER[k]) if k in RESULT_ORDER else f for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from crashlens.plans import oracle_more  # noqa: F401
    return {k: f"{oracle.PRELUDE}\n{body}" for k, body in oracle_queries.BODIES.items()}
