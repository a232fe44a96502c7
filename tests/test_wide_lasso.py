"""The Lasso beyond one Gram matrix, against the optimality conditions and the
fit from one Gram."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerogrid.plans import lasso
from aerogrid.plans import wide_lasso as wide


def _frame(spark, X, Y, parts=4):
    rows = [(x.tolist(), y.tolist()) for x, y in zip(X, Y)]
    return spark.createDataFrame(rows, "x array<double>, y array<double>").repartition(parts)


def _problem(n, d, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 12))
    X = base @ rng.normal(size=(12, d)) + 0.5 * rng.normal(size=(n, d)) + 100.0   # correlated, far from 0
    X[:, 3] = 7.0                                                                # a constant feature
    Y = np.column_stack([X[:, 0] - 2 * X[:, 5] + rng.normal(size=n), 3 * X[:, d - 1] + rng.normal(size=n), rng.normal(size=n)])
    return X, Y


def _conditions(X, Y, W, lam, scaled=True):
    """Broken optimality conditions by the definition, on the driver."""
    Xc = X - X.mean(0)
    if scaled:
        sd = X.std(0)
        Xc = Xc / np.where(sd < 1e-12, 1.0, sd)
    g = Xc.T @ (Y - Y.mean(0) - Xc @ W.T)
    on = W.T != 0
    return int(np.sum(on & (np.abs(g - lam * np.sign(W.T)) > 2e-6 * lam)) + np.sum(~on & (np.abs(g) > lam * (1 + 2e-6))))


@pytest.mark.parametrize("scaled", [True, False])
def test_equals_the_fit_from_one_gram(spark, scaled):
    X, Y = _problem(150, 364, 1)
    df = _frame(spark, X, Y)
    fit = wide.fit_wide(spark, df, 364, 3, 0.1, scaled=scaled)
    W, b = lasso.coef_arrays(wide.dense_coef(spark, fit, 364))
    if scaled:
        mean, std, coef = lasso.fit_scaled_lasso(spark, df, 364, 3, 0.1)
        assert np.allclose(fit.mean, mean) and np.allclose(fit.std, std)
    else:
        coef = lasso.fit_lasso(spark, df, 364, 3, 0.1)
    W1, b1 = lasso.coef_arrays(coef)
    assert np.abs(W - W1).max() < 1e-5 and np.allclose(b, b1, atol=1e-3)
    assert _conditions(X, Y, W, 0.1 * 150, scaled) == 0


def test_twenty_thousand_features(spark):
    X, Y = _problem(120, 20_000, 2)
    df = _frame(spark, X, Y)
    fit = wide.fit_wide(spark, df, 20_000, 3, 0.2)
    W = np.zeros((3, 20_000))
    for r in fit.coef.collect():
        W[r.target, r.idx] = r.coef
    assert np.count_nonzero(W) > 10 and _conditions(X, Y, W, 0.2 * 120) == 0
    assert {r.n_broken for r in wide.broken_conditions(df, fit, 20_000, 3, 0.2).collect()} == {0}
    # and the check does see a wrong coefficient
    fit.coef = fit.coef.withColumn("coef", F.when(F.col("target") == 1, F.col("coef") * 1.01).otherwise(F.col("coef")))
    seen = {r.target: r.n_broken for r in wide.broken_conditions(df, fit, 20_000, 3, 0.2).collect()}
    assert seen[0] == 0 and seen[1] > 0 and seen[2] == 0


def test_blocks_of_features(spark):
    """A working set wider than a block is solved block by block."""
    rng = np.random.default_rng(5)
    X = rng.normal(size=(200, 60))
    Y = (X @ rng.normal(size=60) + rng.normal(size=200))[:, None]
    df = _frame(spark, X, Y)
    fit = wide.fit_wide(spark, df, 60, 1, 0.01, width=25)
    W, _ = lasso.coef_arrays(wide.dense_coef(spark, fit, 60))
    assert np.count_nonzero(W) > 25 and _conditions(X, Y, W, 0.01 * 200) == 0


def test_groups_of_targets(spark, monkeypatch):
    monkeypatch.setattr(wide, "GRADIENT_BYTES", 8 * 40 * 2)      # two targets a group
    X, Y = _problem(80, 40, 3)
    df = _frame(spark, X, Y)
    fit = wide.fit_wide(spark, df, 40, 3, 0.1)
    W, _ = lasso.coef_arrays(wide.dense_coef(spark, fit, 40))
    assert _conditions(X, Y, W, 0.1 * 80) == 0
    assert [r.n_broken for r in wide.broken_conditions(df, fit, 40, 3, 0.1).collect()] == [0, 0, 0]


def test_nothing_to_gain_and_bad_input(spark):
    X, Y = _problem(30, 10, 4)
    fit = wide.fit_wide(spark, _frame(spark, X, Y), 10, 3, 1e9)
    assert fit.coef.count() == 0 and np.allclose(fit.intercept, Y.mean(0))
    W, _ = lasso.coef_arrays(wide.dense_coef(spark, fit, 10))
    assert W.shape == (3, 10) and not W.any()
    with pytest.raises(ValueError, match="no training samples"):
        wide.fit_wide(spark, spark.createDataFrame([], "x array<double>, y array<double>"), 10, 3)
    with pytest.raises(ValueError, match="width"):
        wide.fit_wide(spark, _frame(spark, X, Y), 11, 3)
    with pytest.raises(Exception, match="null or not"):
        wide.fit_wide(spark, spark.createDataFrame([([1.0], [2.0]), ([None], [1.0])], "x array<double>, y array<double>")
                      .coalesce(1), 1, 1)


def test_wide_samples_no_longer_raise(spark, monkeypatch):
    monkeypatch.setattr(lasso, "MAX_WIDTH", 30)
    X, Y = _problem(80, 40, 6)
    _, _, coef = lasso.fit_scaled_lasso(spark, _frame(spark, X, Y), 40, 3, 0.1)
    W, b = lasso.coef_arrays(coef)
    assert _conditions(X, Y, W, 0.1 * 80) == 0 and np.allclose(b, Y.mean(0))
