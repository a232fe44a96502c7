"""Shape and error contracts of the sample builder and model (the original's
unit-test strategy), plus the Lasso solver against its optimality conditions."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from aerogrid.plans import model as M
from aerogrid.plans.lasso import coordinate_descent
from aerogrid.plans.samples import build_samples, fit_scaler, scaler_arrays, time_split
from conftest import SERIES3


def test_sample_shapes(spark, pollution_wide):
    s = build_samples(pollution_wide, SERIES3, T=24, n=6)
    rows = s.orderBy("sample_id").collect()
    assert len(rows) == 100 - 24 - 6 + 1
    assert len(rows[0].x) == 24 * 3 + 4
    assert len(rows[0].y) == 6 * 3
    first = rows[0]
    assert first.sample_id == 0 and first.ts == dt.datetime(2024, 1, 2, 0, 0)
    assert first.x[:3] == pytest.approx([20.5, 25.0, 12.1])
    # time features of row 24: hour 0, Tuesday (weekday 1)
    assert first.x[-4:] == pytest.approx([0.0, 1.0, math.sin(2 * math.pi / 7), math.cos(2 * math.pi / 7)])
    assert first.y[:3] == pytest.approx([22.9, 29.8, 14.5])


def test_split_last_fold(spark, pollution_wide):
    s = build_samples(pollution_wide, SERIES3)
    sp = time_split(s, 71)
    assert sp.where("is_validation").count() == 17
    assert sp.where("NOT is_validation").count() == 54


def test_too_few_rows_raise(spark, pollution_wide):
    short = pollution_wide.where("ts < TIMESTAMP '2024-01-01 03:00:00'")
    with pytest.raises(ValueError):
        M.train(spark, short, SERIES3)


def test_split_needs_four_samples(spark, pollution_wide):
    s = build_samples(pollution_wide, SERIES3)
    with pytest.raises(ValueError):
        time_split(s, 3)


def test_scaler_zero_std_is_one(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "x array<double>")
    mean, std = scaler_arrays(fit_scaler(df))
    assert mean == pytest.approx([2.0, 5.0])
    assert std == pytest.approx([1.0, 1.0])   # population std of (1, 3) is 1; constant column -> 1


def test_coordinate_descent_kkt():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 12))
    y = X[:, 0] * 3 - X[:, 3] * 2 + rng.normal(size=200)
    X = (X - X.mean(0)) / X.std(0)
    yc = y - y.mean()
    G, c = X.T @ X, X.T @ yc
    lam = 0.1 * len(y)
    w = coordinate_descent(G, c, lam)
    grad = c - G @ w
    for j in range(len(w)):
        if w[j] != 0:
            assert grad[j] == pytest.approx(lam * np.sign(w[j]), rel=1e-6, abs=1e-6)
        else:
            assert abs(grad[j]) <= lam + 1e-6
    assert w[0] > 0 and w[3] < 0


def test_train_metrics_and_forecast(spark, pollution_wide):
    m = M.train(spark, pollution_wide, SERIES3)
    assert {"mae", "mse", "rmse", "r2_score"} <= set(m.metrics)
    assert m.metrics["training_samples"] == 54 and m.metrics["validation_samples"] == 17
    fc = M.forecast(spark, pollution_wide, m).collect()
    assert len(fc) == 6 * 3
    assert {r.hour for r in fc} == {f"hour_{j}" for j in range(1, 7)}
    assert {r.pollutant for r in fc} == {"Nitrogen dioxide", "PM10", "PM2.5"}
    assert {r.station for r in fc} == {"Helsinki Kallio 2"}
    # first forecast hour = last timestamp + 1 h
    assert min(r.timestamp for r in fc) == dt.datetime(2024, 1, 5, 4, 0)
    assert max(r.timestamp for r in fc) == dt.datetime(2024, 1, 5, 9, 0)


def test_history_block(spark, pollution_wide):
    h = M.history(pollution_wide, SERIES3, T=24).collect()
    assert len(h) == 24 * 3
    first = [r for r in h if r.hour == "hour_1" and r.pollutant == "Nitrogen dioxide"][0]
    assert first.timestamp == dt.datetime(2024, 1, 4, 4, 0)
    assert first.value == pytest.approx(20.5 + 0.1 * 76)


def test_fit_lasso_matches_mllib(spark):
    """Same objective as MLlib LinearRegression(elasticNetParam=1, standardization=False)."""
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import LinearRegression

    from aerogrid.plans.lasso import coef_arrays, fit_lasso

    rng = np.random.default_rng(1)
    X = rng.normal(size=(300, 6))
    Y = np.stack([X[:, 0] * 2.0 - X[:, 2] + 0.3 * rng.normal(size=300),
                  X[:, 1] * -1.5 + 5.0 + 0.3 * rng.normal(size=300)], axis=1)
    rows = [([float(v) for v in x], [float(v) for v in y]) for x, y in zip(X, Y)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>")
    W, b = coef_arrays(fit_lasso(spark, df, d=6, t=2, alpha=0.1))
    for t in range(2):
        ml = spark.createDataFrame([(Vectors.dense(x), float(y[t])) for x, y in zip(X, Y)], ["features", "label"])
        m = LinearRegression(elasticNetParam=1.0, regParam=0.1, standardization=False, tol=1e-12,
                             maxIter=1000).fit(ml)
        assert np.max(np.abs(np.asarray(m.coefficients) - W[t])) < 1e-4
        assert abs(m.intercept - b[t]) < 1e-4


def test_coordinate_descent_correlated_wide():
    """n < d with strongly correlated columns (like lag features): the staged
    descent with the exact support solve meets the optimality conditions."""
    rng = np.random.default_rng(3)
    n, d = 60, 90
    base = rng.normal(size=(n, 8))
    X = base @ rng.normal(size=(8, d)) + 0.05 * rng.normal(size=(n, d))
    y = X[:, 0] - 2 * X[:, 5] + rng.normal(size=n)
    X = (X - X.mean(0)) / X.std(0)
    G, c = X.T @ X, X.T @ (y - y.mean())
    lam = 0.05 * n
    w = coordinate_descent(G, c, lam)
    grad = c - G @ w
    on = w != 0
    assert on.sum() <= n
    assert np.allclose(grad[on], lam * np.sign(w[on]), rtol=1e-6, atol=1e-6)
    assert np.all(np.abs(grad[~on]) <= lam * (1 + 1e-6))


def test_history_short_input_is_right_aligned(spark, pollution_wide):
    """Fewer than T rows: the newest row is still hour_T (as the SQL twin)."""
    short = pollution_wide.where("ts < TIMESTAMP '2024-01-01 05:00:00'")
    h = M.history(short, SERIES3, T=24).collect()
    hours = sorted({int(r.hour.split("_")[1]) for r in h})
    assert hours == list(range(20, 25))


def test_forecast_without_model_raises(spark, pollution_wide):
    with pytest.raises(ValueError, match="Model is not loaded"):
        M.forecast(spark, pollution_wide, None)


def test_forecast_short_input_is_empty(spark, pollution_wide):
    """Train on an integer ramp, forecast from 3 rows: no full window, so no
    forecast rows (the original tolerates this case or raises)."""
    ramp = pollution_wide.selectExpr(
        "station", "indicator", "ts",
        "CAST((unix_seconds(CAST(ts AS TIMESTAMP)) - unix_seconds(TIMESTAMP '2024-01-01 00:00:00')) / 3600 AS DOUBLE)"
        " AS value")
    m = M.train(spark, ramp, SERIES3)
    short = ramp.where("ts < TIMESTAMP '2024-01-01 03:00:00'")
    assert M.forecast(spark, short, m).count() == 0


def test_feature_table_adds_four_time_columns(spark, pollution_wide):
    from aerogrid.functions.scalars import with_time_features
    from aerogrid.operators.aggregates import to_wide
    wide = to_wide(pollution_wide, SERIES3)
    out = with_time_features(wide)
    assert {"hour_sin", "hour_cos", "day_sin", "day_cos"} <= set(out.columns)
    assert len(out.columns) == len(wide.columns) + 4
    assert out.count() == wide.count() == 100


def test_forecast_quirk_switches(spark, pollution_wide):
    """Q21 clip_at_zero floors predictions at 0; Q3 align_time_features runs
    the same window with the first forecast hour's time features."""
    from pyspark.sql import functions as F
    neg = pollution_wide.withColumn("value", -F.col("value"))
    m = M.train(spark, neg, SERIES3)
    raw = M.forecast(spark, neg, m).collect()
    assert min(r.value for r in raw) < 0
    clipped = M.forecast(spark, neg, m, clip_at_zero=True).collect()
    assert len(clipped) == 18 and min(r.value for r in clipped) == 0.0
    assert len(M.forecast(spark, neg, m, align_time_features=True).collect()) == 18


def test_train_names_a_series_without_values(spark, pollution_wide):
    """Q6: a series with no observed value cannot be filled; training raises
    naming it instead of failing inside the fit."""
    from pyspark.sql import functions as F
    gap = pollution_wide.withColumn(
        "value", F.when(F.col("indicator") == "Particulate matter < 10 µm", F.lit(None).cast("double"))
        .otherwise(F.col("value")))
    with pytest.raises(Exception, match="series with no observed value: Particulate matter < 10 µm_Helsinki"):
        M.train(spark, gap, SERIES3)
