"""ML and forecasting registrations (rows-only keys plus SQL-checkable prep)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.operators import features, forecast, ml, profiling, series
from crashlens.plans.queries import CORR_COLS, T, _daily, _hourly, q
from crashlens.plans.tables import TRAINING_FEATURES
from crashlens.session import stored

ID_COLS = ("collision_index", "vehicle_reference", "casualty_reference")
# registered model sizes: the reference's
MODEL_PARAMS = {"rf": dict(num_trees=100), "gbt": dict(gbt_iter=100), "mlp": dict(mlp_iter=500)}
#: Metrics of a model on a dataset, stored when a key first asks for them in a session.
METRICS: dict[tuple[str, str, str], DataFrame] = {}


def training_columns(spark, sf) -> DataFrame:
    """The loader's rows with the columns of the models, stored: medians, ranks and scales read them again."""
    rows = T(spark, sf).training_rows
    return stored(rows.select(*ID_COLS, *[c for c in TRAINING_FEATURES if c in rows.columns], "casualty_severity"), "training")


def matrix(spark, sf) -> DataFrame:
    return ml.training_matrix(training_columns(spark, sf), TRAINING_FEATURES, id_cols=ID_COLS)


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ID_COLS and c not in ("label", "row_id")]


def with_row_id(df: DataFrame) -> DataFrame:
    return df.withColumn("row_id", F.concat_ws("|", *ID_COLS))


@q("training_matrix")
def _(spark, sf):
    return matrix(spark, sf)


@q("class_distribution")
def _(spark, sf):
    return profiling.class_distribution(matrix(spark, sf))


@q("class_weights")
def _(spark, sf):
    return ml.class_weights(matrix(spark, sf)).withColumn("weight", F.round("weight", 6))


@q("scaled_features")
def _(spark, sf):
    m = matrix(spark, sf)
    names = feature_names(m)
    return ml.standard_scale(m, names, ID_COLS).withColumns({c: F.round(c, 4) for c in names})


@q("macro_metrics")
def _(spark, sf):
    m = matrix(spark, sf)
    rule = (F.when(F.col("speed_limit") >= 60, 1).when(F.col("number_of_casualties") >= 3, 0).otherwise(2))
    return rounded(ml.macro_metrics(m.withColumn("prediction", rule)))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})


def labelled(spark, sf) -> DataFrame:
    return with_row_id(ml.labelled_rows(T(spark, sf).training_rows, TRAINING_FEATURES, id_cols=ID_COLS))


@q("stratified_folds")
def _(spark, sf):
    folds = ml.stratified_folds(stored(labelled(spark, sf).select("row_id", "label"), "labels"), "row_id", 5)
    return folds.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@q("smote_balanced")
def _(spark, sf):
    m = with_row_id(matrix(spark, sf))
    return ml.smote(m, feature_names(m), "row_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def validated(spark, sf, *models: str) -> DataFrame:
    """Cross-validated metrics, one row per model; the model keys and the comparing keys read one stored table."""
    key = lambda m: (spark.sparkContext.applicationId, sf, m)
    missing = [m for m in models if key(m) not in METRICS]
    if missing:
        rows = labelled(spark, sf)
        found = stored(rounded(ml.compare_models(rows, feature_names(rows), "row_id", 5, MODEL_PARAMS, missing)), "metrics")
        METRICS.update({key(m): found.where(F.col("model") == m) for m in missing})
    return reduce(DataFrame.unionByName, [METRICS[key(m)] for m in models])


for _m in ml.MODELS:
    q(f"clf_{_m}")(lambda spark, sf, _m=_m: validated(spark, sf, _m))


@q("model_comparison")
def _(spark, sf):
    return validated(spark, sf, *ml.MODELS)


@q("best_model")
def _(spark, sf):
    return ml.best_model(validated(spark, sf, *ml.MODELS))


@q("cv_metrics")
def _(spark, sf):
    """Cross-validation of all models."""
    return validated(spark, sf, *ml.MODELS)


@q("vif")
def _(spark, sf):
    return profiling.vif(features.ml_training_dataset(T(spark, sf).features()), CORR_COLS)


@q("forecast_arima")
def _(spark, sf):
    return forecast.forecast_in_sample(_hourly(spark, sf), "arima")


@q("forecast_sarima")
def _(spark, sf):
    return forecast.forecast_in_sample(_hourly(spark, sf), "sarima", 24)


@q("forecast_additive")
def _(spark, sf):
    return forecast.forecast_in_sample(_daily(spark, sf), "additive")


@q("forecast_ahead")
def _(spark, sf):
    return (forecast.forecast_ahead(_hourly(spark, sf), 168, "arima")
            .unionByName(forecast.forecast_ahead(_hourly(spark, sf), 168, "sarima", season=24))
            .unionByName(forecast.forecast_ahead(_daily(spark, sf), 7, "additive")))


@q("forecast_comparison")
def _(spark, sf):
    return forecast.compare_models(_hourly(spark, sf))


@q("forecast_lag_regression")
def _(spark, sf):
    return forecast.lag_regression(series.forecast_features(T(spark, sf).collision))


@q("target_encoding")
def _(spark, sf):
    d = features.ml_training_dataset(T(spark, sf).features()).withColumn(
        "is_severe", F.when(F.col("target").isin(1, 2), 1).otherwise(0))
    enc = features.target_encode(d, ["weather_conditions", "light_conditions"], "is_severe")
    return enc.select("collision_index", "weather_conditions_te", "light_conditions_te")


@q("forecast_model_info")
def _(spark, sf):
    return forecast.model_info(_hourly(spark, sf))
