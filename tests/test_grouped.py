"""Grouped fits against one fit per group on the group's rows alone."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from aerogrid import constants as K
from aerogrid.plans import grouped as G
from aerogrid.plans import model as M
from aerogrid.plans import registry as R
from aerogrid.plans.lasso import fit_scaled_lasso
from aerogrid.session import scratch_path

START = dt.datetime(2024, 1, 1)
SERIES = [("A", "NO2"), ("A", "PM10"), ("B", "NO2")]
T, N = 4, 2


@pytest.fixture(scope="module")
def filled(spark):
    rng = np.random.default_rng(5)
    rows = []
    for h in range(260):
        for k, (st, ind) in enumerate(SERIES):
            rows.append((st, ind, START + dt.timedelta(hours=h), float(20 + 9 * k + 8 * np.sin(h / (3 + k)) + rng.normal())))
    return spark.createDataFrame(rows, "station string, indicator string, ts timestamp_ntz, value double").repartition(4).cache()


def hours(a: int) -> dt.datetime:
    return START + dt.timedelta(hours=a)


def test_overlapping_windows_equal_training_each_alone(spark, filled):
    spans = [(1, 0, 120), (2, 60, 180), (3, 100, 259), (4, 100, 140)]
    windows = spark.createDataFrame([(g, hours(a), hours(b)) for g, a, b in spans], "grp bigint, start timestamp_ntz, end timestamp_ntz")
    runs = G.train_windows(filled, SERIES, windows, T, N, alpha=0.3)
    coef = {(r["grp"], r["target"]): r for r in runs.coef.collect()}
    stats = {r["grp"]: r for r in runs.stats.collect()}
    metrics = {r["grp"]: r for r in runs.metrics.collect()}
    assert len(coef) == len(spans) * N * len(SERIES)
    for g, a, b in spans:
        part = filled.where(filled.ts.between(hours(a), hours(b)))
        m = M.train(spark, part, SERIES, T, N, alpha=0.3)
        np.testing.assert_allclose(stats[g]["mean"], m.mean, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(stats[g]["std"], m.std, rtol=1e-9, atol=1e-12)
        assert any(abs(v - 1.0) > 0.5 for v in m.std)
        for t in range(N * len(SERIES)):
            np.testing.assert_allclose(coef[g, t]["coef"], m.W[t], atol=1e-7)
            assert abs(coef[g, t]["intercept"] - m.b[t]) < 1e-9
        for name, value in m.metrics.items():
            assert abs(metrics[g][name] - value) < 1e-7, name


def test_short_window_raises(spark, filled):
    windows = spark.createDataFrame([(1, hours(0), hours(100)), (2, hours(3), hours(9))], "grp bigint, start timestamp_ntz, end timestamp_ntz")
    with pytest.raises(ValueError, match="Cannot have number of folds"):
        G.train_windows(filled, SERIES, windows, T, N)


def test_regions_equal_one_fit_each(spark, filled, monkeypatch):
    monkeypatch.setattr(G, "HELD_BYTES", 1)          # a task emits its matrices at every new key
    monkeypatch.setattr(G, "BLOCK_BYTES", 400)
    monkeypatch.setattr(G, "SLICE_TARGETS", 1)
    no2 = filled.where("indicator = 'NO2'")
    samples = G.region_samples(no2, ["NO2"], T=T, n=N)
    coef, stats = G.fit_regions(samples, alpha=0.2)
    got, scale = {(r["region"], r["target"]): r for r in coef.collect()}, {r["region"]: r for r in stats.collect()}
    assert {r for r, _ in got} == {"A", "B"}
    count = samples.where("region = 'A'").count()
    for region in ("A", "B"):
        train = samples.where((samples.region == region) & (samples.sample_id < count - count // (K.N_SPLITS + 1)))
        mean, std, alone = fit_scaled_lasso(spark, train, T + 4, N, alpha=0.2)
        np.testing.assert_allclose(scale[region]["mean"], mean, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(scale[region]["std"], std, rtol=1e-9, atol=1e-12)
        X = np.array([r["x"] for r in train.collect()])
        Y = np.array([r["y"] for r in train.collect()])
        Xs = (X - np.mean(X, axis=0)) / np.where(np.std(X, axis=0) == 0, 1, np.std(X, axis=0))
        for r in alone.collect():
            w = np.array(got[region, r["target"]]["coef"])
            np.testing.assert_allclose(w, r["coef"], atol=1e-7)
            grad = Xs.T @ (Y[:, r["target"]] - Xs @ w - got[region, r["target"]]["intercept"]) / len(Xs)
            on = w != 0
            assert np.abs(grad[on] - 0.2 * np.sign(w[on])).max(initial=0) < 1e-7 and np.abs(grad[~on]).max(initial=0) <= 0.2 + 1e-7


def test_saved_scaler_comes_back(spark, filled):
    m = M.train(spark, filled, SERIES, T, N, alpha=0.3, run_id="r1")
    root = scratch_path(spark, "models")
    R.save_model(spark, m, root, version=1, stage="Production")
    back = R.load_registered(spark, root)
    assert any(abs(v) > 1 for v in m.mean) and any(abs(v - 1) > 0.5 for v in m.std)
    np.testing.assert_allclose(back.mean, m.mean, rtol=0)
    np.testing.assert_allclose(back.std, m.std, rtol=0)
    a, b = (sorted((r["feature"], r["hour"], r["value"]) for r in M.forecast(spark, filled, x).collect()) for x in (m, back))
    assert a == b and len(a) == N * len(SERIES)
