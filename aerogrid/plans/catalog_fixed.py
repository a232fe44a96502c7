"""Registered queries that put the model operators (M4-M7, M10, M11, F15,
A9, A10, A14-A16, S15, S16) beside SQL: a fixed coefficient table, for which
SQL knows every prediction, a Lasso of one feature, which has a closed form,
and the optimality conditions of the full Lasso."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerogrid import constants as K
from aerogrid.catalog import register
from aerogrid.operators import aggregates as A
from aerogrid.plans import model as M
from aerogrid.plans import registry as R
from aerogrid.plans import wide_lasso
from aerogrid.plans.catalog_core import filled, recent
from aerogrid.plans.catalog_model import FEATURES_SQL, N_FEATURES, N_STEPS, SAMPLES_SQL, T, _train_part, history_of, samples_of, trained
from aerogrid.plans.lasso import fit_lasso, moments, predict
from aerogrid.plans.samples import build_samples
from aerogrid.plans.sqlparts import FILLED_SQL, GRID_SQL, HIST_SQL, RECENT_GRID_SQL, RECENT_SQL, norm_sql, r6
from aerogrid.session import cut_lineage, scratch_path
from aerogrid.sources import sinks
from aerogrid.sources.testbed import testbed_series

RUN_ID = "persistence"


def persistence(metrics: dict | None = None) -> M.Model:
    """The fixed model: every step of a series repeats its last value."""
    d, t = T * N_FEATURES + len(K.TIME_FEATURES), N_STEPS * N_FEATURES
    W = np.zeros((t, d))
    for target in range(t):
        W[target, (T - 1) * N_FEATURES + target % N_FEATURES] = 1.0
    return M.Model(RUN_ID, testbed_series(), T, N_STEPS, [0.0] * d, [1.0] * d, W, np.zeros(t), metrics=metrics or {})


def rounded(col: str):
    return (F.round(col, 6) + F.lit(0.0)).alias(col)


# ------------------------------------------------- predictions and metrics ---

PAIRS_SQL = f"""
SELECT sample_id, target, y[target + 1] AS y, x[{(T - 1) * N_FEATURES + 1} + target % {N_FEATURES}] AS yhat
FROM (SELECT sample_id, x, y, CAST(unnest(range(len(y))) AS INTEGER) AS target FROM ({SAMPLES_SQL}) s) p
"""

METRICS_SQL = f"""
SELECT sum(sa) / sum(n) AS mae, sum(ss) / sum(n) AS mse, sqrt(sum(ss) / sum(n)) AS rmse,
       avg(CASE WHEN tot = 0 THEN CASE WHEN ss = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - ss / tot END) AS r2_score
FROM (SELECT target, sum(abs(y - yhat)) AS sa, sum((y - yhat) * (y - yhat)) AS ss, var_pop(y) * count(*) AS tot, count(*) AS n
      FROM ({PAIRS_SQL}) p GROUP BY target) g
"""


def persistence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = persistence()
    return M.prediction_pairs(predict(spark, samples_of(spark, sf_dir), m.W, m.b, mean=m.mean, std=m.std))


@register("m5_predict_persistence", f"SELECT sample_id, target, {r6('y')} AS y, {r6('yhat')} AS yhat FROM ({PAIRS_SQL}) p")
def q_m5(spark, sf_dir):
    return persistence_pairs(spark, sf_dir).select("sample_id", "target", rounded("y"), rounded("yhat"))


@register("a14_a15_persistence_metrics", "SELECT " + ", ".join(
    f"{r6(m)} AS {m}" for m in K.METRIC_NAMES[:4]) + f" FROM ({METRICS_SQL}) m")
def q_a14(spark, sf_dir):
    return A.regression_metrics(persistence_pairs(spark, sf_dir)).select(*map(rounded, K.METRIC_NAMES[:4]))


@register("a16_m10_model_info_persistence", f"""
SELECT '{K.MODEL_NAME}' AS name, 1 AS version, '{RUN_ID}' AS run_id, 'persiste...' AS run_id_short,
       '{K.STAGE_PRODUCTION}' AS stage, strftime(e.end_ts, '%Y-%m-%d %H:%M') AS created,
       {", ".join(f"{r6(m)} AS {m}" for m in K.METRIC_NAMES[:4])},
       CAST(n.n - n.n // {K.N_SPLITS + 1} AS DOUBLE) AS training_samples, CAST(n.n // {K.N_SPLITS + 1} AS DOUBLE) AS validation_samples,
       CASE {" ".join(f"WHEN r2_score > {b} THEN '{label}'" for b, label in K.R2_BANDS)} ELSE '{K.R2_BAND_DEFAULT}' END AS quality
FROM ({METRICS_SQL}) m, (SELECT max(ts) AS end_ts FROM ({GRID_SQL}) g) e, (SELECT count(*) AS n FROM ({SAMPLES_SQL}) s) n""")
def q_m10(spark, sf_dir):
    """Metrics of the fixed model over all samples, saved with it and read back by the registry."""
    samples = cut_lineage(samples_of(spark, sf_dir))
    m = persistence()
    pred = predict(spark, samples, m.W, m.b, mean=m.mean, std=m.std)
    metrics = A.regression_metrics(M.prediction_pairs(pred)).first().asDict()
    n = samples.count()
    end = filled(spark, sf_dir).select(F.unix_millis(F.max("ts").cast("timestamp"))).first()[0]
    metrics |= {"training_samples": float(n - n // (K.N_SPLITS + 1)), "validation_samples": float(n // (K.N_SPLITS + 1))}
    root = scratch_path(spark, "registry")
    R.save_model(spark, persistence(metrics), root, version=1, stage=K.STAGE_PRODUCTION, created_ms=end)
    info = R.model_info(R.read(spark, root, "model_versions"), R.read(spark, root, "run_metrics"))
    return info.select(*[rounded(c) if c in K.METRIC_NAMES[:4] else c for c in info.columns])


# ---------------------------------------------------------------- forecast ---

FORECAST_SQL = f"""
SELECT l.ts AS at, f.indicator || '_' || f.station AS feature, {norm_sql('f.indicator')} AS pollutant, f.station AS station,
       'hour_' || CAST(s.step AS VARCHAR) AS hour, l.ts + to_hours(CAST(s.step AS BIGINT)) AS timestamp, f.value AS value
FROM ({RECENT_SQL}) f JOIN (SELECT max(ts) AS ts FROM ({RECENT_GRID_SQL}) g) l ON f.ts = l.ts, range(1, {N_STEPS + 1}) AS s(step)
WHERE (SELECT count(DISTINCT ts) FROM ({RECENT_GRID_SQL}) g) >= {T}
"""


def persistence_forecast(spark: SparkSession, sf_dir: str, window: DataFrame | None = None) -> DataFrame:
    """Forecast of the fixed model after it was saved and loaded again by its stage."""
    root = scratch_path(spark, "registry")
    R.save_model(spark, persistence(), root, version=1, stage=K.STAGE_PRODUCTION)
    return M.forecast(spark, recent(spark, sf_dir) if window is None else window, R.load_registered(spark, root))


@register("m7_m11_forecast_persistence", f"SELECT * FROM ({FORECAST_SQL}) f")
def q_m11(spark, sf_dir):
    return persistence_forecast(spark, sf_dir)


@register("s15_s16_forecast_json_persistence", f"SELECT timestamp, pollutant, value, hour, station FROM ({FORECAST_SQL}) f")
def q_s15(spark, sf_dir):
    w = recent(spark, sf_dir)
    pred = persistence_forecast(spark, sf_dir, w)
    path = scratch_path(spark, "forecast-json")
    at = pred.select(F.max("at")).first()[0]
    sinks.write_forecast(M.forecast_document(pred, history_of(spark, sf_dir, w), at), path)
    return M.flatten_forecast(sinks.read_forecast(spark, path), "predictions")


@register("a9_forecast_summary_persistence", f"""
SELECT pollutant, station, round(avg(value), 1) AS avg_predicted, round(max(value), 1) AS max_predicted,
       round(min(value), 1) AS min_predicted FROM ({FORECAST_SQL}) f GROUP BY pollutant, station""")
def q_a9(spark, sf_dir):
    return A.forecast_summary(persistence_forecast(spark, sf_dir))


@register("a10_compare_means_persistence", f"""
SELECT pollutant, {r6('h.m')} AS hist_avg, {r6('p.m')} AS pred_avg, {r6('p.m - h.m')} AS change,
       {r6('CASE WHEN h.m <> 0 THEN (p.m - h.m) / h.m * 100 ELSE 0 END')} AS change_pct
FROM (SELECT pollutant, avg(value) AS m FROM ({HIST_SQL}) x GROUP BY pollutant) h
JOIN (SELECT pollutant, avg(value) AS m FROM ({FORECAST_SQL}) x GROUP BY pollutant) p USING (pollutant)""")
def q_a10(spark, sf_dir):
    w = recent(spark, sf_dir)
    out = A.compare_means(persistence_forecast(spark, sf_dir, w), history_of(spark, sf_dir, w))
    return out.select("pollutant", *[rounded(c) for c in out.columns if c != "pollutant"])


# ------------------------------------------------------------------- Lasso ---

# One feature x and free intercept: w = soft(cov(x, y), alpha) / var(x), b = mean(y) - w mean(x).
@register("m4_lasso_one_feature", f"""
WITH f AS ({FILLED_SQL}),
     v AS (SELECT f.ts, fe.feature_idx AS target, f.value AS y, max(CASE WHEN fe.feature_idx = 0 THEN f.value END) OVER (PARTITION BY f.ts) AS x,
                  row_number() OVER (PARTITION BY fe.feature_idx ORDER BY f.ts) AS rn
           FROM f JOIN ({FEATURES_SQL}) fe ON f.station = fe.station AND f.indicator = fe.indicator),
     m AS (SELECT target, covar_pop(y, x) AS c, var_pop(x) AS s, avg(x) AS mx, avg(y) AS my FROM v WHERE rn > 1 GROUP BY target),
     w AS (SELECT *, sign(c) * greatest(abs(c) - {K.LASSO_ALPHA}, 0) / s AS coef FROM m)
SELECT CAST(target AS INTEGER) AS target, {r6('coef')} AS coef, {r6('my - coef * mx')} AS intercept FROM w""")
def q_m4_one(spark, sf_dir):
    """Each series of an hour on the first series of that hour."""
    s = build_samples(filled(spark, sf_dir), testbed_series(), 1, 1).select(F.slice("y", 1, 1).alias("x"), "y")
    coef = fit_lasso(spark, cut_lineage(s), 1, N_FEATURES, K.LASSO_ALPHA)
    return coef.select("target", (F.round(F.element_at("coef", 1), 6) + 0.0).alias("coef"), rounded("intercept"))


@register("m4_lasso_optimality", f"SELECT CAST(range AS INTEGER) AS target, true AS optimal FROM range({N_STEPS * N_FEATURES})")
def q_m4_kkt(spark, sf_dir):
    """Per target, whether the fitted Lasso meets its optimality conditions on
    the training samples: the mean product of each standardised feature with
    the residual is ``alpha`` times the coefficient's sign, or within
    ``alpha`` where the coefficient is zero."""
    m = trained(spark, sf_dir)
    part, _ = _train_part(spark, sf_dir)
    pred = predict(spark, part, m.W, m.b, mean=m.mean, std=m.std).select(
        "x", F.zip_with("y", "yhat", lambda a, b: a - b).alias("residual"))
    st = moments(cut_lineage(pred), len(m.mean), len(m.b), y="residual")
    slope = (st["mxy"] / np.array(m.std)[:, None] / st["n"]).T
    active = m.W != 0
    good = np.where(active, np.abs(slope - m.alpha * np.sign(m.W)) < 1e-6, np.abs(slope) <= m.alpha + 1e-6).all(axis=1)
    good &= np.abs(st["my"]) < 1e-6            # the free intercept leaves residuals of mean 0
    return spark.createDataFrame([(i, bool(g)) for i, g in enumerate(good)], "target int, optimal boolean")


WIDE_T = 336   # two weeks of lags: more features than one Gram holds
WIDE_ALPHA = 8.0   # above the noise of so many features over a month of samples


@register("m4_wide_lasso", f"""
WITH v AS (SELECT f.ts, list(f.value ORDER BY fe.feature_idx) AS vec
           FROM ({FILLED_SQL}) f JOIN ({FEATURES_SQL}) fe ON f.station = fe.station AND f.indicator = fe.indicator
           GROUP BY f.ts),
     w AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS idx, count(*) OVER () AS rows,
                  list(vec) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND {N_STEPS - 1} FOLLOWING) AS lead FROM v),
     y AS (SELECT CAST(unnest(range(len(flatten(lead)))) AS INTEGER) AS target, unnest(flatten(lead)) AS v
           FROM w WHERE idx >= {WIDE_T} AND len(lead) = {N_STEPS})
SELECT target, count(*) AS n_train, {WIDE_T * N_FEATURES + len(K.TIME_FEATURES)} AS n_features, {r6('avg(v)')} AS intercept, 0 AS n_broken
FROM y GROUP BY target""")
def q_m4_wide(spark, sf_dir):
    """The Lasso on two weeks of lags, wider than one Gram matrix: samples,
    intercept per target, and optimality conditions that the fit breaks."""
    s = cut_lineage(build_samples(filled(spark, sf_dir), testbed_series(), WIDE_T, N_STEPS))
    d, t = WIDE_T * N_FEATURES + len(K.TIME_FEATURES), N_STEPS * N_FEATURES
    fit = wide_lasso.fit_wide(spark, s, d, t, WIDE_ALPHA)
    intercept = F.element_at(F.array(*[F.lit(float(b)) for b in fit.intercept]), F.col("target") + 1)
    return wide_lasso.broken_conditions(s, fit, d, t, WIDE_ALPHA).select(
        "target", F.lit(fit.n).cast("long").alias("n_train"), F.lit(d).alias("n_features"),
        (F.round(intercept, 6) + 0.0).alias("intercept"), F.col("n_broken").cast("int").alias("n_broken"))
