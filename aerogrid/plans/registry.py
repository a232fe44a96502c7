"""Model artefacts and version registry as Parquet tables.

Tables under one root folder (append-only, keyed by ``run_id``):

* ``model_coef(run_id, target, intercept, coef array<double>)``
* ``model_scaler(run_id, idx, mean, std)``
* ``model_meta(run_id, training_hours, n_steps, features, features_additional,
  model_type, alpha, created_at)``
* ``run_metrics(run_id, metric, value)``
* ``model_versions(name, version, run_id, stage, creation_timestamp)``
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerogrid import constants as K
from aerogrid.plans.model import Model

#: Tables with one partition per run, and their columns.
RUN_TABLES = {
    "model_coef": "run_id string, target int, intercept double, coef array<double>",
    "model_scaler": "run_id string, idx int, mean double, std double",
    "run_metrics": "run_id string, metric string, value double",
    "model_meta": "run_id string, training_hours int, n_steps int, features array<string>, "
                  "features_additional array<string>, model_type string, alpha double, created_ms bigint",
}
TABLES = (*RUN_TABLES, "model_versions")


def _path(root: str, name: str) -> str:
    return os.path.join(root, name)


def save_model(spark: SparkSession, model: Model, root: str, version: int, stage: str = K.STAGE_NONE,
               created_ms: int = 0, name: str = K.MODEL_NAME) -> None:
    """Write the model tables for one run and register a version (M7).

    Artefacts lie in one partition per run, which a second save of the run
    replaces; only the version rows are appended.  The metadata is written
    last, so a run without it was not saved whole.
    """
    rid = model.run_id
    rows = {
        "model_coef": [(rid, int(t), float(model.b[t]), [float(v) for v in model.W[t]]) for t in range(len(model.b))],
        "model_scaler": [(rid, i, float(m), float(s)) for i, (m, s) in enumerate(zip(model.mean, model.std))],
        "run_metrics": [(rid, k, float(v)) for k, v in model.metrics.items()],
        "model_meta": [(rid, model.T, model.n, model.features, list(K.TIME_FEATURES), K.MODEL_TYPE, float(model.alpha),
                        int(created_ms))],
    }
    for table, data in rows.items():
        (spark.createDataFrame(data, RUN_TABLES[table]).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(_path(root, table)))
    ver = [(name, int(version), rid, stage, int(created_ms))]
    spark.createDataFrame(ver, "name string, version int, run_id string, stage string, creation_timestamp bigint") \
        .write.mode("append").parquet(_path(root, "model_versions"))


def save_runs(root: str, coef: DataFrame, scaler: DataFrame, metrics: DataFrame, meta: DataFrame, versions: DataFrame) -> None:
    """Write the tables of many runs at once (M7, M9): frames with the columns
    of the tables, ``run_id`` among them.  The metadata comes last but for the
    versions, so a run that is listed was saved whole."""
    for table, df in zip(("model_coef", "model_scaler", "run_metrics", "model_meta"), (coef, scaler, metrics, meta), strict=True):
        names = [c.split()[0] for c in RUN_TABLES[table].split(", ")]
        (df.select(*names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_id").parquet(_path(root, table)))
    versions.select("name", "version", "run_id", "stage", "creation_timestamp").write.mode("append").parquet(_path(root, "model_versions"))


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    reader = spark.read.schema(RUN_TABLES[table]) if table in RUN_TABLES else spark.read
    return reader.parquet(_path(root, table))


def load_model(spark: SparkSession, root: str, run_id: str) -> Model:
    """Load one run's artefacts; metadata defaults T=24, n=6 when absent (M7)."""
    meta = read(spark, root, "model_meta").where(F.col("run_id") == run_id).select(
        F.coalesce("training_hours", F.lit(K.TRAINING_HOURS)).alias("T"),
        F.coalesce("n_steps", F.lit(K.N_STEPS)).alias("n"), "features", "alpha").first()
    if meta is None:
        raise ValueError(f"no model stored for run {run_id}")
    coef = read(spark, root, "model_coef").where(F.col("run_id") == run_id).orderBy("target").toPandas()
    sc = read(spark, root, "model_scaler").where(F.col("run_id") == run_id).orderBy("idx").toPandas()
    mets = {r["metric"]: r["value"] for r in
            read(spark, root, "run_metrics").where(F.col("run_id") == run_id).collect()}
    series = []
    for f in meta["features"]:
        ind, st = f.split("_", 1)
        series.append((st, ind))
    W = np.vstack([np.asarray(v, dtype=np.float64) for v in coef["coef"]])
    return Model(run_id, series, int(meta["T"]), int(meta["n"]), sc["mean"].tolist(), sc["std"].tolist(),
                 W, coef["intercept"].to_numpy(dtype=np.float64), float(meta["alpha"]), mets)


def load_registered(spark: SparkSession, root: str, name: str = K.MODEL_NAME, version: int | None = None,
                    run_id: str | None = None) -> Model:
    """Resolve a version as ``resolve_model`` does and load its run (M7, M8)."""
    row = resolve_model_row(read(spark, root, "model_versions"), name=name, version=version, run_id=run_id)
    return load_model(spark, root, row["run_id"])


def resolve_model(versions: DataFrame, name: str = K.MODEL_NAME, version: int | None = None,
                  run_id: str | None = None) -> DataFrame:
    """Which version to serve (M8, O4): the explicit version, else the run,
    else the newest Production version, else the newest version in stage
    None.  At most one row; empty when nothing qualifies."""
    v = versions.where(F.col("name") == name)
    if version is not None:
        return v.where(F.col("version") == version).limit(1)
    if run_id is not None:
        return v.where(F.col("run_id") == run_id).orderBy(F.col("version").desc()).limit(1)
    pri = F.when(F.col("stage") == K.STAGE_PRODUCTION, 0).when(F.col("stage") == K.STAGE_NONE, 1)
    cand = v.where(pri.isNotNull()).withColumn("_pri", pri)
    return cand.orderBy("_pri", F.col("version").desc()).limit(1).drop("_pri")


def resolve_model_row(versions: DataFrame, **kw):
    row = resolve_model(versions, **kw).first()
    if row is None:
        raise ValueError("No model version found")
    return row


def list_models(versions: DataFrame, name: str = K.MODEL_NAME) -> DataFrame:
    """Versions of one model name (M9)."""
    return versions.where(F.col("name") == name).select("version", "run_id", "stage", "creation_timestamp")


def latest_per_stage(versions: DataFrame, name: str = K.MODEL_NAME) -> DataFrame:
    """Newest version in every stage (the registry's "latest versions")."""
    w = Window.partitionBy("stage").orderBy(F.col("version").desc())
    return (versions.where(F.col("name") == name).withColumn("_rn", F.row_number().over(w))
            .where("_rn = 1").drop("_rn"))


def model_info(versions: DataFrame, metrics: DataFrame, name: str = K.MODEL_NAME) -> DataFrame:
    """Resolved version joined to its run metrics, metrics pivoted."""
    chosen = resolve_model(versions, name)
    piv = metrics.groupBy("run_id").pivot("metric", K.METRIC_NAMES).agg(F.first("value"))
    from aerogrid.functions.scalars import epoch_millis_text, r2_band, short_run_id
    j = chosen.join(piv, "run_id", "left")
    return j.select("name", "version", "run_id", short_run_id("run_id").alias("run_id_short"), "stage",
                    epoch_millis_text("creation_timestamp").alias("created"),
                    *[F.col(m) for m in K.METRIC_NAMES], r2_band("r2_score").alias("quality"))
