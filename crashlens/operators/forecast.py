"""Forecasts of many series at once.

Models are regressions, fitted in Spark: lags are read from the rows before, the
sums of products of the design (normal equations) are added up map-side and per
series, and only the small solve of k x k numbers per series runs in Python.
Fitted values, residuals, information criteria and future designs are column
expressions.  A long series is cut into chunks of periods, whose first lags are
copied from the chunk before, so no task needs a whole series.

* ARIMA(p,1,q) and SARIMA(1,1,1)(1,1,1,s) by Hannan-Rissanen: difference, fit a
  long autoregression to estimate innovations, then regress on lagged values and
  lagged innovations;
* an additive model with a piecewise-linear trend (changepoints) and Fourier
  seasonalities, fitted by ridge regression.

Series are gap-filled rows (series_key, ts, y) at a regular step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "series_key"
#: Periods of a series that one task handles together.
CHUNK = 4096


@dataclass(frozen=True)
class Arma:
    """Differencing (lag -> factor), lags of values and innovations, length of the long autoregression."""

    difference: tuple[tuple[int, int], ...]
    values: tuple[int, ...]
    innovations: tuple[int, ...]
    long: int


def arma(model: str, season: int, p: int = 5, q: int = 2) -> Arma:
    if model == "arima":
        return Arma(((1, -1),), tuple(range(1, p + 1)), tuple(range(1, q + 1)), 20)
    if model == "sarima":
        s = season
        return Arma(((1, -1), (s, -1), (s + 1, 1)), (1, s, s + 1), (1, s, s + 1), 2 * s + 2)
    raise ValueError(f"unknown model: {model}")


def indexed(series: DataFrame) -> DataFrame:
    """series_key, ts, y, t (period number from 0), n, step (seconds)."""
    seconds = lambda c: F.unix_date(F.col(c).cast("date")) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    bounds = series.groupBy(KEY).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n"))
    span = seconds("hi") - seconds("lo")
    step = F.when(F.col("n") > 1, (span / (F.col("n") - 1)).cast("long")).otherwise(F.lit(3600))
    bounds = bounds.select(KEY, "lo", "n", step.alias("step"))
    return series.join(bounds, KEY).select(
        KEY, "ts", F.col("y").cast("double").alias("y"), F.round((seconds("ts") - seconds("lo")) / F.col("step")).cast("long").alias("t"), "n", "step")


def with_history(rows: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """``<column>_before``: array of the column's last ``most`` values before the row,
    newest last (shorter at the start of a series)."""
    chunk = F.explode(F.array_distinct(F.array(F.floor(F.col("t") / CHUNK), F.floor((F.col("t") + most) / CHUNK))))
    own = Window.partitionBy(KEY, "chunk").orderBy("t").rowsBetween(-most, -1)
    dealt = rows.withColumn("chunk", chunk)
    for c in columns:
        dealt = dealt.withColumn(f"{c}_before", F.collect_list(F.struct(c)).over(own))
    return dealt.filter(F.col("chunk") == F.floor(F.col("t") / CHUNK)).drop("chunk")


def lag(column: str, by: int) -> Column:
    """The value ``by`` periods before (NULL at the start)."""
    before = F.col(f"{column}_before")
    return F.get(before, F.size(before) - by)[column]


def dot(x: str, coef: str) -> Column:
    return F.aggregate(F.zip_with(x, coef, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def solved(rows: DataFrame, ridge: Column | None = None) -> DataFrame:
    """series_key, coef (array): least squares of ``target`` on the array ``x`` per series.
    ``ridge`` is added to the diagonal; it must be the same in all rows of a series."""
    source = rows.filter("x IS NOT NULL AND target IS NOT NULL").select(KEY, "x", "target", (F.lit(0.0) if ridge is None else ridge).alias("ridge"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, g in pdf.groupby(KEY):
                x = np.stack(g["x"].to_numpy())
                both = np.column_stack([x, g["target"].to_numpy()])
                out.append((key, len(g), float(g["ridge"].iloc[0]), (both.T @ both).ravel().tolist()))
            yield pd.DataFrame(out, columns=[KEY, "n", "ridge", "sums"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)
        k = int(round(len(sums) ** 0.5))
        sums = sums.reshape(k, k)
        gram = sums[:-1, :-1] + float(pdf["ridge"].iloc[0]) * np.eye(k - 1)
        enough = pdf["n"].sum() > k - 1
        coef = np.linalg.lstsq(gram, sums[:-1, -1], rcond=None)[0] if enough else np.zeros(k - 1)
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "coef": [coef.tolist()]})

    parts = source.mapInPandas(partial, f"{KEY} string, n long, ridge double, sums array<double>")
    return parts.groupBy(KEY).applyInPandas(solve, f"{KEY} string, coef array<double>")


def fitted_arma(series: DataFrame, spec: Arma) -> tuple[DataFrame, DataFrame]:
    """(rows with y, z, e, fit, yhat; coefficients of the last regression per series)."""
    reach = max(d for d, _ in spec.difference)
    rows = with_history(indexed(series), ["y"], reach)
    past = sum((F.lit(float(c)) * lag("y", d) for d, c in spec.difference), F.lit(0.0))
    rows = rows.withColumn("past", past).drop("y_before").withColumn("z", F.col("y") + F.col("past"))
    rows = with_history(rows, ["z"], max(spec.long, *spec.values))
    started = F.col("t") >= reach
    long = F.array(F.lit(1.0), *[lag("z", i) for i in range(1, spec.long + 1)])
    rows = rows.withColumn("x", F.when(started & (F.col("t") >= reach + spec.long), long)).withColumn("target", F.col("z"))
    first = solved(rows).withColumnRenamed("coef", "long_coef")
    rows = rows.join(first, KEY, "left").withColumn("e", F.when(F.col("x").isNotNull(), F.col("z") - dot("x", "long_coef")).otherwise(0.0))
    rows = with_history(rows.drop("x", "target"), ["e"], max(spec.innovations))
    design = F.array(F.lit(1.0), *[lag("z", i) for i in spec.values], *[lag("e", i) for i in spec.innovations])
    rows = rows.withColumn("x", F.when(F.col("t") >= reach + spec.long, design)).withColumn("target", F.col("z"))
    coef = solved(rows)
    fit = F.when(F.col("x").isNotNull(), dot("x", "coef"))
    rows = rows.join(coef, KEY, "left").withColumn("fit", fit).withColumn("yhat", F.col("fit") - F.col("past"))
    return rows.select(KEY, "ts", "t", "n", "step", "y", "z", "e", "fit", "yhat"), coef


# ---- additive model -----------------------------------------------------------
CHANGEPOINTS = tuple(float(c) for c in np.linspace(0, 0.8, 27)[1:-1])
#: (period in hours, number of harmonics); a period must be longer than two steps
SEASONS = ((24 * 365.25, 10), (24 * 7, 3), (24.0, 4))
SCALE = 0.05


def additive_design(share: Column, hours: Column, step: Column) -> Column:
    """Trend with hinges at the changepoints, and harmonics of the seasons."""
    cols = [F.lit(1.0), share, *[F.greatest(F.lit(0.0), share - c) for c in CHANGEPOINTS]]
    for period, order in SEASONS:
        fits = step * 2 < period * 3600
        for k in range(1, order + 1):
            angle = hours * (2 * np.pi * k / period)
            cols += [F.when(fits, F.sin(angle)).otherwise(0.0), F.when(fits, F.cos(angle)).otherwise(0.0)]
    return F.array(*cols)


def _hours(ts: str) -> Column:
    return F.unix_date(F.col(ts).cast("date")) * 24.0 + F.hour(ts)


def _share() -> Column:
    return F.col("t") / F.greatest(F.col("n") - 1, F.lit(1))


def fitted_additive(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with y and yhat; coefficients with the mean and deviation they are scaled by)."""
    rows = indexed(series)
    scale = rows.groupBy(KEY).agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"))
    scale = scale.withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    rows = rows.join(scale, KEY).withColumn("x", additive_design(_share(), _hours("ts"), F.col("step")))
    rows = rows.withColumn("target", (F.col("y") - F.col("mean")) / F.col("sd"))
    coef = solved(rows, 1.0 / (SCALE * F.col("n"))).join(scale, KEY)
    rows = rows.drop("mean", "sd").join(coef, KEY).withColumn("yhat", dot("x", "coef") * F.col("sd") + F.col("mean"))
    return rows.select(KEY, "ts", "t", "n", "step", "y", "yhat"), coef


def fitted(series: DataFrame, model: str, season: int = 24) -> tuple[DataFrame, DataFrame]:
    return fitted_additive(series) if model == "additive" else fitted_arma(series, arma(model, season))


def forecast_in_sample(series: DataFrame, model: str, season: int = 24) -> DataFrame:
    """In-sample one-step predictions (NULL where a series has too little history)."""
    return fitted(series, model, season)[0].select(KEY, F.lit(model).alias("model"), "ts", "y", "yhat")


def model_info(series: DataFrame, models=("arima", "sarima", "additive"), season: int = 24) -> DataFrame:
    """N, SSE, AIC, BIC and status per (series, model)."""
    out = None
    for m in models:
        rows, coef = fitted(series, m, season)
        sse = rows.groupBy(KEY).agg(F.count("yhat").alias("n"), F.sum((F.col("y") - F.col("yhat")) ** 2).alias("sse"))
        one = sse.join(coef.select(KEY, F.size("coef").alias("k")), KEY, "left")
        fit = (F.col("n") > 0) & (F.col("sse") > 0)
        spread = F.when(fit, F.col("n") * F.log(F.col("sse") / F.col("n")))
        one = one.select(KEY, F.lit(m).alias("model"), "n", "sse", (spread + 2 * F.col("k")).alias("aic"),
                         (spread + F.col("k") * F.log("n")).alias("bic"),
                         F.when(F.col("n") > 0, "ok").otherwise("too short").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


STATE = ("model", "season", "ar", "ma", "ts", "n", "step", "coef", "mean", "sd", "recent")


def model_state(series: DataFrame, model: str = "additive", season: int = 24, p: int = 5, q: int = 2) -> DataFrame:
    """One row per series with all that a forecast needs: the coefficients in the order of the
    design and, for the additive model, mean and deviation of the values, for the others the
    last values, differences and innovations (a season of them for ``sarima``)."""
    bounds = [F.max("ts").alias("ts"), F.first("n").alias("n"), F.first("step").alias("step")]
    named = [F.lit(model).alias("model"), *(F.lit(v).alias(n) for n, v in (("season", season), ("ar", p), ("ma", q)))]
    none = F.lit(None).cast("double")
    if model == "additive":
        rows, coef = fitted_additive(series)
        ends = rows.groupBy(KEY).agg(*bounds).withColumn("recent", F.lit(None).cast("array<struct<t: bigint, y: double, z: double, e: double>>"))
        return ends.join(coef, KEY).select("*", *named).select(KEY, *STATE)
    spec = arma(model, season, p, q)
    rows, coef = fitted_arma(series, spec)
    reach = max(max(d for d, _ in spec.difference), *spec.values, *spec.innovations)
    shock = F.coalesce(F.col("z") - F.col("fit"), F.lit(0.0)).alias("e")
    ends = rows.filter(F.col("t") >= F.col("n") - reach).groupBy(KEY).agg(*bounds, F.array_sort(F.collect_list(F.struct("t", "y", "z", shock))).alias("recent"))
    return ends.join(coef, KEY).select("*", none.alias("mean"), none.alias("sd"), *named).select(KEY, *STATE)


def continued(coef: Sequence[float], spec: Arma, y: list[float], z: list[float], e: list[float], horizon: int) -> list[float]:
    """The values after ``y``, with future innovations 0; what lies before the history counts as 0."""
    reach = max(max(d for d, _ in spec.difference), *spec.values, *spec.innovations)
    y, z, e = ([0.0] * reach + list(v) for v in (y, z, e))
    for _ in range(horizon):
        z.append(float(np.dot(coef, [1.0, *(z[-i] for i in spec.values), *(e[-i] for i in spec.innovations)])))
        e.append(0.0)
        y.append(z[-1] - sum(c * y[-d] for d, c in spec.difference))
    return y[len(y) - horizon:]


def forecast_from(state: DataFrame, horizon: int = 168) -> DataFrame:
    """The periods after the end of each series of :func:`model_state`, at its own step, without a fit."""
    later = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    ahead = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("step") * F.col("h"))
    named = [KEY, "model", "ts", F.lit(None).cast("double").alias("y"), "yhat"]
    future = state.filter("model = 'additive'").select("*", later).withColumn("ts", ahead).withColumn("t", F.col("n") + F.col("h") - 1)
    future = future.withColumn("x", additive_design(_share(), _hours("ts"), F.col("step")))
    additive = future.withColumn("yhat", dot("x", "coef") * F.col("sd") + F.col("mean")).select(*named)

    def go_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = []
            for model, season, p, q, coef, recent in zip(*(pdf[c] for c in ("model", "season", "ar", "ma", "coef", "recent"))):
                y, z, e = ([r[c] if r[c] is not None and not np.isnan(r[c]) else 0.0 for r in recent] for c in "yze")
                paths.append(continued(coef, arma(model, int(season), int(p), int(q)), y, z, e, horizon))
            yield pdf[[KEY, "model", "ts", "step"]].assign(path=paths)

    paths = state.filter("model <> 'additive'").mapInPandas(go_on, f"{KEY} string, model string, ts timestamp_ntz, step long, path array<double>")
    steps = paths.select(KEY, "model", "ts", "step", F.posexplode("path").alias("h", "yhat")).withColumn("h", F.col("h") + 1)
    return additive.unionByName(steps.withColumn("ts", ahead).select(*named))


def forecast_ahead(series: DataFrame, horizon: int = 168, model: str = "additive", p: int = 5,
                   q: int = 2, season: int = 24) -> DataFrame:
    """Future periods of a freshly fitted model: ``additive`` evaluates its design at future
    times, ``arima`` and ``sarima`` continue the differenced series."""
    return forecast_from(model_state(series, model, season, p, q), horizon)


def save_state(state: DataFrame, path: str) -> None:
    """The fitted models as a table."""
    state.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`save_state` wrote, for :func:`forecast_from`."""
    return spark.read.parquet(path)


def compare_models(series: DataFrame, models=("arima", "sarima", "additive"), season: int = 24) -> DataFrame:
    """In-sample metrics of each model per series; lowest MAE wins."""
    from crashlens.operators.series import forecast_metrics

    preds = None
    for m in models:
        p = forecast_in_sample(series, m, season)
        preds = p if preds is None else preds.unionByName(p)
    met = forecast_metrics(preds)
    w = Window.partitionBy(KEY).orderBy("mae", "model")
    return met.withColumn("rank", F.row_number().over(w)).withColumn("is_best", F.col("rank") == 1).drop("rank")


def lag_regression(features: DataFrame, test_fraction: float = 0.2) -> DataFrame:
    """Linear regression on the W2 lag features, scored out of sample on
    the last ``test_fraction`` of days (time-based split)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    cols = ["lag_1day", "lag_7days", "lag_30days", "rolling_7day_mean", "dow", "month", "is_weekend"]
    df = features.dropna(subset=cols)
    # one row per day after W2's aggregate: the ordered window is bounded by the span
    ranked = df.withColumn("__r", F.percent_rank().over(Window.orderBy("date_of_accident")))
    train = ranked.filter(F.col("__r") < 1 - test_fraction)
    test = ranked.filter(F.col("__r") >= 1 - test_fraction)
    asm = VectorAssembler(inputCols=cols, outputCol="features")
    lr = LinearRegression(featuresCol="features", labelCol="target", regParam=0.0)
    m = lr.fit(asm.transform(train))
    pred = m.transform(asm.transform(test))
    return pred.select(F.lit("ALL").alias(KEY), F.lit("lag_regression").alias("model"),
                       F.col("date_of_accident").cast("timestamp_ntz").alias("ts"),
                       F.col("target").cast("double").alias("y"), F.col("prediction").alias("yhat"))


def save_coefficients(series: DataFrame, path: str, model: str = "additive", season: int = 24) -> None:
    """All that is needed to use the fitted model again, one row per series: the
    coefficients in the order of the design, and for the additive model the mean and
    deviation of the values and the changepoints."""
    coef = fitted(series, model, season)[1].withColumn("model", F.lit(model))
    if model == "additive":
        coef = coef.withColumn("changepoints", F.array(*map(F.lit, CHANGEPOINTS)))
    coef.write.mode("overwrite").parquet(path)
