"""Projections and feature expressions (P1-P13): narrow, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlens.functions import codes
from crashlens.functions.expr import flag, tod_minutes


def time_period(hour: Column, night: str = "literal") -> Column:
    """P3.  ``night='literal'`` keeps the source's ``BETWEEN 22 AND 6`` (never
    true, so no 'Night'); ``night='wrap'`` means hour >= 22 or hour <= 6."""
    night_cond = hour.between(22, 6) if night == "literal" else ((hour >= 22) | (hour <= 6))
    return (F.when(hour.between(7, 9), "Morning Rush")
            .when(hour.between(15, 18), "Evening Rush")
            .when(night_cond, "Night")
            .otherwise("Off-Peak"))


def risk_flags(df_cols=None) -> dict[str, Column]:
    """The four condition flags on raw codes."""
    return {
        "dark": flag(F.col("light_conditions").isin(*codes.DARK_LIGHT)),
        "adverse_weather": flag(F.col("weather_conditions").isin(*codes.ADVERSE_WEATHER)),
        "poor_surface": flag(F.col("road_surface_conditions").isin(*codes.POOR_SURFACE)),
        "high_speed": flag(F.col("speed_limit") >= codes.HIGH_SPEED),
    }


def with_features(collision: DataFrame, night: str = "literal") -> DataFrame:
    """``collision_with_features``."""
    minutes = tod_minutes("time_of_accident")
    d = F.col("date_of_accident")
    enriched = collision.withColumn("__m", minutes)
    hour = (F.col("__m") / 60).cast("int")
    return enriched.select(
        *[F.col(c) for c in collision.columns],
        hour.alias("hour_of_day"),
        (F.dayofweek(d) - 1).alias("day_of_week"),
        F.month(d).alias("month"),
        F.year(d).alias("year"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.date_format(d, "MMMM").alias("month_name"),
        (hour * 4 + (F.col("__m") % 60 / 15).cast("int")).alias("time_slot_15min"),
        time_period(hour, night).alias("time_period"),
        (F.dayofweek(d) - 1).isin(0, 6).alias("is_weekend"),
        codes.decode_domain("collision_severity", "severity").alias("severity_label"),
        codes.decode_domain("weather_conditions", "weather").alias("weather_label"),
        codes.decode_domain("light_conditions", "light").alias("light_label"),
        codes.decode_domain("road_surface_conditions", "surface").alias("road_surface_label"),
        codes.decode_domain("road_type", "road_type").alias("road_type_label"),
        codes.decode_domain("urban_or_rural_area", "area").alias("area_type_label"),
    )


def collision_risk_scores(features: DataFrame) -> DataFrame:
    """Five binary flags, their sum 0-5 and a level."""
    f = risk_flags()
    weekend = flag(F.col("is_weekend"))
    scored = features.select(
        "collision_index", "date_of_accident", "time_of_accident", "collision_severity",
        f["dark"].alias("dark_risk"), f["adverse_weather"].alias("adverse_weather_risk"),
        f["poor_surface"].alias("poor_surface_risk"), f["high_speed"].alias("high_speed_risk"),
        weekend.alias("weekend_risk"),
    )
    total = (F.col("dark_risk") + F.col("adverse_weather_risk") + F.col("poor_surface_risk")
             + F.col("high_speed_risk") + F.col("weekend_risk"))
    return scored.withColumn("total_risk_score", total).withColumn(
        "risk_level",
        F.when(F.col("total_risk_score") >= 3, "High Risk")
        .when(F.col("total_risk_score") == 2, "Medium Risk")
        .otherwise("Low Risk"))


def ml_training_dataset(features: DataFrame) -> DataFrame:
    """COALESCE defaults, flags on raw codes, non-null filters."""
    f = risk_flags()
    return features.filter(
        F.col("collision_severity").isNotNull() & F.col("hour_of_day").isNotNull()
        & F.col("day_of_week").isNotNull()
    ).select(
        F.col("collision_severity").alias("target"),
        "hour_of_day", "day_of_week", "month",
        flag(F.col("is_weekend")).alias("is_weekend"),
        "time_slot_15min",
        F.coalesce("weather_conditions", F.lit(1)).alias("weather_conditions"),
        F.coalesce("light_conditions", F.lit(1)).alias("light_conditions"),
        F.coalesce("road_surface_conditions", F.lit(1)).alias("road_surface_conditions"),
        F.coalesce("road_type", F.lit(6)).alias("road_type"),
        F.coalesce("speed_limit", F.lit(30)).alias("speed_limit"),
        F.coalesce("urban_or_rural_area", F.lit(1)).alias("urban_or_rural_area"),
        F.coalesce("junction_detail", F.lit(0)).alias("junction_detail"),
        "number_of_vehicles", "number_of_casualties",
        f["dark"].alias("is_dark"), f["adverse_weather"].alias("is_adverse_weather"),
        f["poor_surface"].alias("is_poor_surface"), f["high_speed"].alias("is_high_speed"),
        "collision_index",
    )


def label_notebook(df: DataFrame, maps: dict | None = None) -> DataFrame:
    """``<col>_label`` for every mapped column present (unmapped -> NULL)."""
    maps = maps or codes.NOTEBOOK_LABELS
    present = [c for c in maps if c in df.columns]
    return df.select("*", *[codes.decode(F.col(c).cast("double"), maps[c], None).alias(f"{c}_label")
                            for c in present])


def notebook_time_features(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """P10: hour, day name, month, 15-minute slot from a timestamp."""
    t = F.col(ts)
    return df.select("*", F.hour(t).alias("hour"), F.date_format(t, "EEEE").alias("day"),
                     F.month(t).alias("month"),
                     (F.hour(t) * 4 + (F.minute(t) / 15).cast("int")).alias("time_slot_15min"))


def slot_label(slot: Column) -> Column:
    """Slot 0..95 -> 'HH:MM' (integer division)."""
    return F.concat(F.lpad((slot / 4).cast("int").cast("string"), 2, "0"), F.lit(":"),
                    F.lpad(((slot % 4) * 15).cast("string"), 2, "0"))


def engineered_features(features: DataFrame) -> DataFrame:
    """Recommended transforms: cyclic hour, rush flag, wet x dark, log."""
    h = F.col("hour_of_day").cast("double")
    return features.select(
        "collision_index",
        F.round(F.sin(F.lit(2.0 * 3.141592653589793) * h / 24), 6).alias("hour_sin"),
        F.round(F.cos(F.lit(2.0 * 3.141592653589793) * h / 24), 6).alias("hour_cos"),
        flag(F.col("hour_of_day").between(7, 9) | F.col("hour_of_day").between(15, 18)).alias("is_rush_hour"),
        flag(F.col("road_surface_conditions").isin(*codes.POOR_SURFACE)
             & F.col("light_conditions").isin(*codes.DARK_LIGHT)).alias("wet_and_dark"),
        F.round(F.log1p(F.col("number_of_casualties").cast("double")), 6).alias("log_casualties"),
        F.least(F.col("number_of_vehicles"), F.lit(4)).alias("vehicles_clipped"),
    )


def target_encode(df: DataFrame, cols, target: str, smoothing: float = 10.0, suffix: str = "_te",
                  coded: bool = True) -> DataFrame:
    """Smoothed target mean per category value,
    ``(sum + smoothing * prior) / (n + smoothing)``.

    The prior is one row (appended by broadcast).  For coded columns
    (``coded=True``) the per-category table has one row per code, bounded by
    the code domain, and is broadcast; otherwise the optimizer chooses the
    join by measured size."""
    from crashlens.functions.expr import attach_one_row

    prior = df.agg(F.avg(F.col(target).cast("double")).alias("__prior"))
    out = attach_one_row(df, prior)
    for c in cols:
        stats = df.groupBy(c).agg(F.count(F.lit(1)).alias(f"__n_{c}"),
                                  F.sum(F.col(target).cast("double")).alias(f"__s_{c}"))
        out = out.join(F.broadcast(stats) if coded else stats, c, "left").withColumn(
            f"{c}{suffix}",
            F.round((F.col(f"__s_{c}") + smoothing * F.col("__prior")) / (F.col(f"__n_{c}") + smoothing), 6))
        out = out.drop(f"__n_{c}", f"__s_{c}")
    return out.drop("__prior")


def one_hot(df: DataFrame, cols, suffix: str = "_vec"):
    """One-hot vectors of integer-coded columns (Spark ML pipeline;
    NULL codes are kept as their own category)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep") for c in cols]
    stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in cols], outputCols=[f"{c}{suffix}" for c in cols],
                                handleInvalid="keep"))
    model = Pipeline(stages=stages).fit(df)
    return model.transform(df).drop(*[f"{c}__idx" for c in cols])
