"""Registered model queries: samples, split, scaler, Lasso fit,
predict, metrics, registry, forecast and the forecast document."""

from __future__ import annotations

import datetime as dt
import math
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerogrid import constants as K
from aerogrid.catalog import register
from aerogrid.functions import scalars as S
from aerogrid.operators import aggregates as A
from aerogrid.plans import grouped as G
from aerogrid.plans import model as M
from aerogrid.plans import registry as R
from aerogrid.plans.catalog_core import filled, recent
from aerogrid.plans.lasso import predict
from aerogrid.plans.samples import build_samples, fit_scaler, scale, scaler_arrays, time_split
from aerogrid.plans.sqlparts import FILLED_SQL, GRID_SQL, HIST_SQL, RECENT_GRID_SQL, norm_sql, r6, wide_sql
from aerogrid.session import cut_lineage, scratch_path
from aerogrid.sources import sinks
from aerogrid.sources.testbed import testbed_series

T, N_STEPS = K.TRAINING_HOURS, K.N_STEPS
N_FEATURES = len(K.TESTBED_STATIONS) * len(K.INDICATORS)

FEATURES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{s}', '{ind}')" for i, (s, ind) in enumerate(testbed_series())
) + ") AS t(feature_idx, station, indicator)"

SAMPLES_SQL = f"""
WITH f AS ({FILLED_SQL}),
     v AS (SELECT f.ts, list(f.value ORDER BY fe.feature_idx) AS vec
           FROM f JOIN ({FEATURES_SQL}) fe ON f.station = fe.station AND f.indicator = fe.indicator
           GROUP BY f.ts),
     w AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS idx,
                  list(vec) OVER (ORDER BY ts ROWS BETWEEN {T} PRECEDING AND 1 PRECEDING) AS lag,
                  list(vec) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND {N_STEPS - 1} FOLLOWING) AS lead
           FROM v)
SELECT idx - {T} AS sample_id, ts,
       list_concat(flatten(lag), [sin(2 * pi() * hour(ts) / 24.0), cos(2 * pi() * hour(ts) / 24.0),
                                  sin(2 * pi() * (isodow(ts) - 1) / 7.0), cos(2 * pi() * (isodow(ts) - 1) / 7.0)]) AS x,
       flatten(lead) AS y
FROM w WHERE len(lag) = {T} AND len(lead) = {N_STEPS}
"""

SPLIT_SQL = f"""
WITH s AS ({SAMPLES_SQL}), n AS (SELECT count(*) AS n FROM s)
SELECT s.*, s.sample_id >= n.n - n.n // {K.N_SPLITS + 1} AS is_validation FROM s, n
"""

SCALER_SQL = f"""
WITH e AS (SELECT CAST(unnest(range(len(x))) AS INTEGER) AS idx, unnest(x) AS v
           FROM ({SPLIT_SQL}) s WHERE NOT is_validation)
SELECT idx, avg(v) AS mean, CASE WHEN stddev_pop(v) = 0 THEN 1.0 ELSE stddev_pop(v) END AS std
FROM e GROUP BY idx
"""


def _explode_xy(samples):
    xs = samples.select("sample_id", "ts", F.lit("x").alias("part"), F.posexplode("x").alias("pos", "val"))
    ys = samples.select("sample_id", "ts", F.lit("y").alias("part"), F.posexplode("y").alias("pos", "val"))
    out = xs.unionByName(ys)
    return out.select("sample_id", "ts", "part", "pos", (F.round("val", 6) + F.lit(0.0)).alias("val"))


def samples_of(spark, sf_dir):
    return build_samples(filled(spark, sf_dir), testbed_series(), T, N_STEPS)


@register("m1_build_samples", f"""
WITH s AS ({SAMPLES_SQL}),
     e AS (SELECT sample_id, ts, 'x' AS part, CAST(unnest(range(len(x))) AS INTEGER) AS pos, unnest(x) AS val FROM s
           UNION ALL
           SELECT sample_id, ts, 'y' AS part, CAST(unnest(range(len(y))) AS INTEGER) AS pos, unnest(y) AS val FROM s)
SELECT sample_id, ts, part, pos, {r6('val')} AS val FROM e""")
def q_m1(spark, sf_dir):
    return _explode_xy(samples_of(spark, sf_dir))


@register("m2_time_split", f"SELECT sample_id, is_validation FROM ({SPLIT_SQL}) s")
def q_m2(spark, sf_dir):
    s = samples_of(spark, sf_dir)
    return time_split(s, s.count()).select("sample_id", "is_validation")


def _train_part(spark, sf_dir):
    s = samples_of(spark, sf_dir)
    split = time_split(s, s.count())
    return split.where(~F.col("is_validation")).drop("is_validation"), split


@register("a13_fit_scaler", f"SELECT idx, {r6('mean')} AS mean, {r6('std')} AS std FROM ({SCALER_SQL}) sc")
def q_a13(spark, sf_dir):
    tr, _ = _train_part(spark, sf_dir)
    sc = fit_scaler(tr)
    return sc.select("idx", (F.round("mean", 6) + 0.0).alias("mean"), (F.round("std", 6) + 0.0).alias("std"))


@register("m3_scale", f"""
WITH e AS (SELECT sample_id, CAST(unnest(range(len(x))) AS INTEGER) AS idx, unnest(x) AS v FROM ({SPLIT_SQL}) s)
SELECT e.sample_id, e.idx AS pos, {r6('(e.v - sc.mean) / sc.std')} AS val
FROM e JOIN ({SCALER_SQL}) sc ON e.idx = sc.idx""")
def q_m3(spark, sf_dir):
    tr, split = _train_part(spark, sf_dir)
    mean, std = scaler_arrays(fit_scaler(tr))
    sc = scale(split, mean, std)
    return sc.select("sample_id", F.posexplode("x").alias("pos", "val")).select(
        "sample_id", "pos", (F.round("val", 6) + 0.0).alias("val"))


# ------------------------------------------------------------ fitted model ---

_FITTED: dict = {}


def input_state(spark, sf_dir) -> tuple:
    """What the events' files are now: their number and a digest of path, size and time."""
    files = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return tuple(files.agg(F.count("*"), F.expr("bit_xor(xxhash64(file_path, file_size, file_modification_time))")).first())


def fitted_once(what: str, spark, sf_dir, fit):
    """``fit()``, done once per session and state of the input files."""
    key = (what, spark.sparkContext.applicationId, sf_dir, *input_state(spark, sf_dir))
    if key not in _FITTED:
        _FITTED[key] = fit()
    return _FITTED[key]


def trained(spark, sf_dir) -> M.Model:
    """The model fitted on the whole input as it is now."""
    return fitted_once("model", spark, sf_dir, lambda: M.train(
        spark, filled(spark, sf_dir), testbed_series(), T, N_STEPS, K.LASSO_ALPHA,
        run_id=f"run-{zlib.crc32(sf_dir.encode()):08x}"))


@register("m4_fit_lasso")
def q_m4(spark, sf_dir):
    m = trained(spark, sf_dir)
    rows = [(t, float(m.b[t]), i, float(m.W[t, i])) for t in range(m.W.shape[0]) for i in range(m.W.shape[1])]
    return spark.createDataFrame(rows, "target int, intercept double, idx int, coef double")


_REGION_SQL = f"""
WITH v AS (SELECT station, ts, list(value ORDER BY CASE indicator {' '.join(f"WHEN '{ind}' THEN {i}" for i, ind in enumerate(K.INDICATORS))} END) AS vec
           FROM ({FILLED_SQL}) f GROUP BY station, ts),
     w AS (SELECT station, row_number() OVER o - 1 AS idx,
                  list(vec) OVER (PARTITION BY station ORDER BY ts ROWS BETWEEN {T} PRECEDING AND 1 PRECEDING) AS lag,
                  list(vec) OVER (PARTITION BY station ORDER BY ts ROWS BETWEEN CURRENT ROW AND {N_STEPS - 1} FOLLOWING) AS lead
           FROM v WINDOW o AS (PARTITION BY station ORDER BY ts)),
     s AS (SELECT station, idx - {T} AS sample_id, flatten(lead) AS y FROM w WHERE len(lag) = {T} AND len(lead) = {N_STEPS}),
     n AS (SELECT count(DISTINCT sample_id) AS n FROM s)
SELECT station AS region, CAST(unnest(range(len(y))) AS INTEGER) AS target, unnest(y) AS v
FROM s, n WHERE sample_id < n.n - n.n // {K.N_SPLITS + 1}"""


@register("m4_region_models", f"""
SELECT region, target, {r6('avg(v)')} AS intercept, count(*) AS n_train, {T * len(K.INDICATORS) + len(K.TIME_FEATURES)} AS n_coef
FROM ({_REGION_SQL}) r GROUP BY region, target""")
def q_m4_regions(spark, sf_dir):
    """A model per station of its own three series, all from one moment aggregate."""
    coef, stats = G.fit_regions(G.region_samples(filled(spark, sf_dir), K.INDICATORS))
    return coef.join(stats, "region").select("region", "target", (F.round("intercept", 6) + 0.0).alias("intercept"),
                                             F.col("n").alias("n_train"), F.size("coef").alias("n_coef"))


@register("m5_predict")
def q_m5(spark, sf_dir):
    m = trained(spark, sf_dir)
    _, split = _train_part(spark, sf_dir)
    va = split.where(F.col("is_validation")).drop("is_validation")
    pred = predict(spark, va, m.W, m.b, mean=m.mean, std=m.std)
    return M.prediction_pairs(pred)


@register("m6_train_metrics")
def q_m6(spark, sf_dir):
    return M.metrics_frame(spark, trained(spark, sf_dir)).select("metric", "value")


# With standardised features (mean 0 on the train part) the Lasso intercept is
# the train mean of each target, so the stored intercepts have a SQL twin.
@register("m7_save_load_model", f"""
WITH e AS (SELECT CAST(unnest(range(len(y))) AS INTEGER) AS target, unnest(y) AS v
           FROM ({SPLIT_SQL}) s WHERE NOT is_validation)
SELECT target, {r6('avg(v)')} AS intercept, CAST({T * N_FEATURES + len(K.TIME_FEATURES)} AS INTEGER) AS n_coef
FROM e GROUP BY target""")
def q_m7(spark, sf_dir):
    m = trained(spark, sf_dir)
    root = scratch_path(spark, "models")
    R.save_model(spark, m, root, version=1, stage=K.STAGE_PRODUCTION, created_ms=0)
    back = R.load_model(spark, root, m.run_id)
    return R.read(spark, root, "model_coef").where(F.col("run_id") == back.run_id).select(
        "target", (F.round("intercept", 6) + 0.0).alias("intercept"), F.size("coef").alias("n_coef"))


# SQL twin of the registry rows ``weekly_registry`` writes: the versions depend
# on the grid's first and last timestamp (week ends counted back from the last).
REGISTRY_SQL = f"""
WITH e AS (SELECT max(ts) AS end_ts, CAST(greatest(ceil(date_diff('hour', min(ts), max(ts)) / {K.CHUNK_HOURS}.0)
                  - {K.TRAIN_CHUNKS - 1}, 1) AS INTEGER) AS weeks FROM ({GRID_SQL}) g),
     w AS (SELECT end_ts, weeks, CAST(unnest(range(weeks)) AS INTEGER) AS w FROM e)
SELECT '{K.MODEL_NAME}' AS name, weeks - w AS version,
       'week-' || lpad(CAST(weeks - w AS VARCHAR), 3, '0') AS run_id,
       CASE w WHEN 0 THEN '{K.STAGE_NONE}' WHEN 1 THEN '{K.STAGE_PRODUCTION}' ELSE 'Archived' END AS stage,
       epoch_ms(end_ts - to_hours(CAST(w * {K.CHUNK_HOURS} AS BIGINT))) AS creation_timestamp
FROM w
"""


def weekly_registry(spark, sf_dir) -> str:
    return fitted_once("registry", spark, sf_dir, lambda: _back_fill(spark, sf_dir))


def _back_fill(spark, sf_dir) -> str:
    """Back-fill the weekly retraining: one run per week-end, each trained on
    the preceding two weeks, as many as it takes to reach the first
    timestamp.  The newest run is registered in stage None (not promoted
    yet), the one before in Production, older ones Archived."""
    f = cut_lineage(filled(spark, sf_dir), "filled")
    begin, end = f.select(F.min("ts"), F.max("ts")).first()
    weeks = max(1, math.ceil((end - begin) / dt.timedelta(hours=K.CHUNK_HOURS)) - (K.TRAIN_CHUNKS - 1))
    root = scratch_path(spark, "registry")

    def back(hours) -> Column:
        return S.ts_lit(end) - F.make_dt_interval(F.lit(0), hours)

    w = F.lit(weeks) - F.col("grp")
    windows = spark.range(1, weeks + 1).select(
        F.col("id").alias("grp")).select("grp", back((w + K.TRAIN_CHUNKS) * K.CHUNK_HOURS).alias("start"), back(w * K.CHUNK_HOURS).alias("end"))
    runs = G.train_windows(f, testbed_series(), windows, T, N_STEPS, K.LASSO_ALPHA)
    run_id = F.concat(F.lit("week-"), F.lpad(F.col("grp").cast("string"), 3, "0")).alias("run_id")
    created = F.unix_millis(F.col("end").cast("timestamp"))
    stage = F.when(w == 0, K.STAGE_NONE).when(w == 1, K.STAGE_PRODUCTION).otherwise("Archived")
    features = [f"{ind}_{st}" for st, ind in testbed_series()]
    meta = windows.select(run_id, F.lit(T).alias("training_hours"), F.lit(N_STEPS).alias("n_steps"),
                          F.array(*map(F.lit, features)).alias("features"), F.array(*map(F.lit, K.TIME_FEATURES)).alias("features_additional"),
                          F.lit(K.MODEL_TYPE).alias("model_type"), F.lit(float(K.LASSO_ALPHA)).alias("alpha"), created.alias("created_ms"))
    scaler = runs.stats.select(run_id, F.posexplode(F.arrays_zip("mean", "std")).alias("idx", "s")).select("run_id", "idx", "s.mean", "s.std")
    metrics = runs.metrics.select(run_id, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in K.METRIC_NAMES])))
    versions = windows.select(F.lit(K.MODEL_NAME).alias("name"), F.col("grp").cast("int").alias("version"), run_id, stage.alias("stage"),
                              created.alias("creation_timestamp"))
    R.save_runs(root, runs.coef.withColumn("run_id", run_id), scaler, metrics, meta, versions)
    return root


@register("m8_resolve_model", f"""
SELECT * FROM ({REGISTRY_SQL}) r
ORDER BY CASE stage WHEN '{K.STAGE_PRODUCTION}' THEN 0 WHEN '{K.STAGE_NONE}' THEN 1 END, version DESC
LIMIT 1""")
def q_m8(spark, sf_dir):
    root = weekly_registry(spark, sf_dir)
    return R.resolve_model(R.read(spark, root, "model_versions"))


@register("m9_list_models",
          f"SELECT version, run_id, stage, creation_timestamp FROM ({REGISTRY_SQL}) r WHERE name = '{K.MODEL_NAME}'")
def q_m9(spark, sf_dir):
    root = weekly_registry(spark, sf_dir)
    return R.list_models(R.read(spark, root, "model_versions"))


@register("m10_model_info")
def q_m10(spark, sf_dir):
    root = weekly_registry(spark, sf_dir)
    return R.model_info(R.read(spark, root, "model_versions"), R.read(spark, root, "run_metrics"))


def forecast_of(spark, sf_dir, window=None):
    return M.forecast(spark, recent(spark, sf_dir) if window is None else window, trained(spark, sf_dir))


def history_of(spark, sf_dir, window=None):
    return M.history(recent(spark, sf_dir) if window is None else window, testbed_series(), T)


@register("m11_forecast")
def q_m11(spark, sf_dir):
    return forecast_of(spark, sf_dir)


def document_of(spark, sf_dir):
    w = recent(spark, sf_dir)
    at = w.select(F.max("ts")).first()[0]
    return M.forecast_document(forecast_of(spark, sf_dir, w), history_of(spark, sf_dir, w), at)


@register("m14_flatten_forecast", f"SELECT timestamp, pollutant, value, hour, station FROM ({HIST_SQL}) h")
def q_m14(spark, sf_dir):
    return M.flatten_forecast(document_of(spark, sf_dir), "historical_data")


@register("s15_s16_forecast_json")
def q_s15(spark, sf_dir):
    path = scratch_path(spark, "forecast-json")
    sinks.write_forecast(document_of(spark, sf_dir), path)
    return M.flatten_forecast(sinks.read_forecast(spark, path), "predictions")


@register("a7_forecast_overview", f"""
WITH h AS ({HIST_SQL}),
     p AS (SELECT fe.station, {norm_sql('fe.indicator')} AS pollutant, s.step
           FROM ({FEATURES_SQL}) fe CROSS JOIN range({N_STEPS}) AS s(step)
           WHERE (SELECT count(DISTINCT ts) FROM ({RECENT_GRID_SQL}) g) >= {T})
SELECT (SELECT count(*) FROM h) AS historical_points, (SELECT count(*) FROM p) AS predicted_points,
       (SELECT count(DISTINCT pollutant) FROM p) AS n_pollutants,
       (SELECT count(DISTINCT station) FROM p) AS n_stations""")
def q_a7(spark, sf_dir):
    w = recent(spark, sf_dir)
    return A.forecast_overview(forecast_of(spark, sf_dir, w), history_of(spark, sf_dir, w))


@register("a9_forecast_summary")
def q_a9(spark, sf_dir):
    return A.forecast_summary(forecast_of(spark, sf_dir))


@register("a10_compare_means")
def q_a10(spark, sf_dir):
    w = recent(spark, sf_dir)
    return A.compare_means(forecast_of(spark, sf_dir, w), history_of(spark, sf_dir, w))


_WIDE = wide_sql(FILLED_SQL)
_PRED_WINDOW = f"ts > (SELECT max(ts) FROM ({_WIDE}) w2) - INTERVAL {K.PREDICT_WINDOW_HOURS} HOUR"


@register("m16_data_status", f"""
SELECT 'training' AS dataset, count(*) > 0 AS available, count(*) AS n_rows, {1 + N_FEATURES} AS n_columns,
       {T + N_STEPS + K.TRAIN_EXTRA_ROWS} AS min_required, count(*) >= {T + N_STEPS + K.TRAIN_EXTRA_ROWS} AS sufficient
FROM ({_WIDE}) w
UNION ALL
SELECT 'prediction', count(*) > 0, count(*), {1 + N_FEATURES}, {T + N_STEPS}, count(*) >= {T + N_STEPS}
FROM ({_WIDE}) w WHERE {_PRED_WINDOW}""")
def q_m16(spark, sf_dir):
    wide = A.to_wide(filled(spark, sf_dir), testbed_series())
    # the times alone are landed, one row each, so that the grid is made once for the last of them and the counts
    rows = cut_lineage(wide.select("ts"), "wide-times")
    lo = rows.select(F.max("ts") - F.make_dt_interval(F.lit(0), F.lit(K.PREDICT_WINDOW_HOURS))).scalar()
    return M.data_status(rows, {"training": F.lit(True), "prediction": F.col("ts") > lo}, len(wide.columns))


@register("entry_flagship")
def q_entry(spark, sf_dir):
    """Flagship: gap-filled series -> Lasso forecast -> summary per pollutant x station."""
    return A.forecast_summary(forecast_of(spark, sf_dir))
