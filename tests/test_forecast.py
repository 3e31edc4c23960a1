"""Forecasts against numpy: coefficients, continued paths, saved models."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from crashlens.operators import forecast

START = datetime(2024, 1, 1)


def values(n, seed=0):
    r = np.random.default_rng(seed)
    t = np.arange(n)
    return 20 + 0.01 * t + 5 * np.sin(2 * np.pi * t / 24) + r.normal(size=n)


def table(spark, series):
    rows = [(k, START + timedelta(hours=i), float(v)) for k, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_key string, ts timestamp_ntz, y double").repartition(4)


def plain_arma(y, spec):
    """(coefficients, differences, residuals) by least squares on the whole series."""
    reach = max(d for d, _ in spec.difference)
    z = np.full(len(y), np.nan)
    for t in range(reach, len(y)):
        z[t] = y[t] + sum(c * y[t - d] for d, c in spec.difference)
    e, first = np.zeros(len(y)), reach + spec.long
    x = np.array([[1.0, *(z[t - i] for i in range(1, spec.long + 1))] for t in range(first, len(y))])
    e[first:] = z[first:] - x @ np.linalg.lstsq(x, z[first:], rcond=None)[0]
    x = np.array([[1.0, *(z[t - i] for i in spec.values), *(e[t - i] for i in spec.innovations)] for t in range(first, len(y))])
    coef = np.linalg.lstsq(x, z[first:], rcond=None)[0]
    shock = np.zeros(len(y))
    shock[first:] = z[first:] - x @ coef
    return coef, z, shock


@pytest.mark.parametrize("model, n", [("arima", 400), ("sarima", 400), ("arima", forecast.CHUNK + 300)])
def test_coefficients_and_path_equal_numpy(spark, model, n):
    y = values(n)
    spec = forecast.arma(model, 24)
    coef, z, e = plain_arma(y, spec)
    state = forecast.model_state(table(spark, {"a": y}), model).first()
    assert np.allclose(state["coef"], coef, atol=1e-5)
    got = [r["yhat"] for r in forecast.forecast_ahead(table(spark, {"a": y}), 30, model).orderBy("ts").collect()]
    ys, zs, es = list(y), list(z), list(e)
    for _ in range(30):
        zs.append(coef @ [1.0, *(zs[-i] for i in spec.values), *(es[-i] for i in spec.innovations)])
        es.append(0.0)
        ys.append(zs[-1] - sum(c * ys[-d] for d, c in spec.difference))
    assert np.allclose(got, ys[n:], atol=1e-3)


def test_seasonal_forecast_differs_and_keeps_the_season(spark):
    y = 20 + 5 * np.sin(2 * np.pi * np.arange(480) / 24) + np.random.default_rng(1).normal(size=480) * 0.1
    got = forecast.forecast_ahead(table(spark, {"a": y}), 48, "sarima").orderBy("ts").collect()
    assert {r["model"] for r in got} == {"sarima"} and got[0]["ts"] == START + timedelta(hours=480)
    assert np.abs(np.array([r["yhat"] for r in got]) - (20 + 5 * np.sin(2 * np.pi * np.arange(480, 528) / 24))).max() < 1.0


@pytest.mark.parametrize("model", ["arima", "sarima", "additive"])
def test_forecast_after_load_equals_forecast_before_save(spark, tmp_path, model):
    state = forecast.model_state(table(spark, {"a": values(300), "b": values(200, 2), "short": values(3)}), model)
    forecast.save_state(state, str(tmp_path / "m"))
    rows = lambda s: sorted(map(tuple, forecast.forecast_from(s, 12).select("series_key", "model", "ts", F.round("yhat", 6)).collect()))
    again = rows(forecast.load_state(spark, str(tmp_path / "m")))
    assert again == rows(state) and len(again) >= 24


def test_additive_fit_equals_ridge_regression(spark):
    y = values(200)
    rows, coef = forecast.fitted_additive(table(spark, {"a": y}))
    got = [r["yhat"] for r in rows.orderBy("ts").collect()]
    hours = np.array([(START - datetime(1970, 1, 1)).days * 24 + i for i in range(200)], float)
    share = np.arange(200) / 199
    x = [np.ones(200), share, *(np.maximum(0, share - c) for c in forecast.CHANGEPOINTS)]
    for period, order in forecast.SEASONS:
        for k in range(1, order + 1):
            x += [np.sin(hours * 2 * np.pi * k / period), np.cos(hours * 2 * np.pi * k / period)]
    x, target = np.stack(x, 1), (y - y.mean()) / y.std()
    beta = np.linalg.lstsq(x.T @ x + np.eye(x.shape[1]) / (forecast.SCALE * 200), x.T @ target, rcond=None)[0]
    assert np.allclose(got, x @ beta * y.std() + y.mean(), atol=1e-4)


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        forecast.forecast_ahead(table(spark, {"a": values(50)}), 5, "lstm")
