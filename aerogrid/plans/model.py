"""Train, forecast and the views built on a forecast."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from aerogrid import constants as K
from aerogrid.functions import scalars as S
from aerogrid.operators.aggregates import regression_metrics
from aerogrid.operators.project import require_nonempty, require_rows
from aerogrid.operators.windows import rows_at_latest
from aerogrid.plans.lasso import coef_arrays, fit_scaled_lasso, predict
from aerogrid.plans.samples import build_samples, require_samples, time_split, wide_rows
from aerogrid.session import cut_lineage


@dataclass
class Model:
    run_id: str
    series: list[tuple[str, str]]
    T: int
    n: int
    mean: list[float]
    std: list[float]
    W: np.ndarray
    b: np.ndarray
    alpha: float = K.LASSO_ALPHA
    metrics: dict = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [f"{ind}_{st}" for st, ind in self.series]


def prediction_pairs(pred: DataFrame) -> DataFrame:
    """(sample_id, target, y, yhat) rows from array columns."""
    z = pred.select("sample_id", F.posexplode(F.arrays_zip("y", "yhat")).alias("target", "p"))
    return z.select("sample_id", F.col("target").cast("int").alias("target"),
                    F.col("p.y").alias("y"), F.col("p.yhat").alias("yhat"))


def train(spark: SparkSession, filled: DataFrame, series: Sequence[tuple[str, str]],
          T: int = K.TRAINING_HOURS, n: int = K.N_STEPS, alpha: float = K.LASSO_ALPHA,
          run_id: str | None = None) -> Model:
    """Build samples, split, scale, fit, score (M6).

    Samples are checkpointed to the shared folder once (cuts lineage, survives
    executor loss); every later step reads them.
    """
    series = list(series)
    require_nonempty(filled, "training data")
    samples = cut_lineage(build_samples(filled, series, T, n))
    N = require_samples(samples)
    split = time_split(samples, N)
    tr = split.where(~F.col("is_validation")).drop("is_validation")
    va = split.where(F.col("is_validation")).drop("is_validation")
    d, t = T * len(series) + len(K.TIME_FEATURES), n * len(series)
    # scaler (A13) and scaled fit (M3, M4) from one moment pass over the train part
    mean, std, coef = fit_scaled_lasso(spark, tr, d, t, alpha)
    W, b = coef_arrays(coef)
    pred = predict(spark, va, W, b, mean=mean, std=std)
    m = regression_metrics(prediction_pairs(pred)).collect()[0].asDict()
    n_val = N // (K.N_SPLITS + 1)
    m.update(training_samples=float(N - n_val), validation_samples=float(n_val))
    return Model(run_id or uuid.uuid4().hex, series, T, n, mean, std, W, b, alpha, m)


def metrics_frame(spark: SparkSession, model: Model) -> DataFrame:
    """``run_metrics(run_id, metric, value)``."""
    rows = [(model.run_id, k, float(model.metrics[k])) for k in K.METRIC_NAMES if k in model.metrics]
    return spark.createDataFrame(rows, "run_id string, metric string, value double")


def tail_timestamps(filled: DataFrame, k: int, ts: str = "ts") -> list:
    """The last ``k`` distinct timestamps, oldest first (at most ``k`` values).

    Distinct timestamps (partial aggregate) -> top k (TakeOrdered): only the
    tail is ever ordered, and only ``k`` values reach the driver.
    """
    top = filled.select(ts).distinct().orderBy(F.col(ts).desc()).limit(k).collect()
    return sorted(r[0] for r in top)


def _tail(filled: DataFrame, stamps: list, ts: str) -> DataFrame:
    # a literal lower bound: the filter reaches the Parquet scan
    return filled.where(F.col(ts) >= S.ts_lit(stamps[0])) if stamps else filled.limit(0)


def latest_rows(filled: DataFrame, series: Sequence[tuple[str, str]], k: int, ts: str = "ts") -> DataFrame:
    """The last ``k`` wide rows (by time order): ``(ts, vec)``.

    The tail start is found first; the filter on ``ts`` then reaches the
    scan, so only the last ``k`` timestamps are assembled.
    """
    return wide_rows(_tail(filled, tail_timestamps(filled, k, ts), ts), series, ts)


def forecast(spark: SparkSession, filled: DataFrame, model: Model | None, at=None, ts: str = "ts",
             align_time_features: bool = False, clip_at_zero: bool = False, strict: bool = False) -> DataFrame:
    """Next ``n`` hours for every series from the latest ``T`` rows.

    Output ``forecast(at, feature, pollutant, station, hour, timestamp, value)``:
    the latest window is one group of T rows (bounded), the scaled input one
    row, and the prediction is exploded to (step, feature) by index math.
    Fewer than T rows give an empty forecast, or with ``strict`` an error that
    names the rows needed and found.

    Quirk switches (defaults keep the original): ``align_time_features``
    takes the time features of the first forecast hour, as training pairs a
    sample with its first target row (Q3), instead of the last history row;
    ``clip_at_zero`` floors predictions at 0 (Q21).
    """
    if model is None:
        raise ValueError("Model is not loaded")
    T, n, nf = model.T, model.n, len(model.series)
    if strict:
        require_rows(filled.select(ts).distinct(), T, "hourly rows")
    win = latest_rows(filled, model.series, T, ts)
    row = win.agg(F.array_sort(F.collect_list(F.struct(ts, "vec"))).alias("w"),
                  F.max(ts).alias("last_ts"))
    row = row.where(F.size("w") == T)
    tf_ts = S.add_hours(F.col("last_ts"), F.lit(1)) if align_time_features else F.col("last_ts")
    x = F.concat(F.flatten(F.col("w.vec")), F.array(*S.cyclic_time_features(tf_ts)))
    inp = row.select(F.lit(0).cast("long").alias("sample_id"), "last_ts", x.alias("x"))
    pred = predict(spark, inp, model.W, model.b, mean=model.mean, std=model.std)
    at_col = F.col("last_ts") if at is None else S.ts_lit(at)
    feats = F.array(*[F.lit(f) for f in model.features])
    ex = pred.select(at_col.alias("at"), F.posexplode("yhat").alias("t", "value"))
    if clip_at_zero:
        ex = ex.withColumn("value", F.greatest(F.col("value"), F.lit(0.0)))
    step = S.target_step(F.col("t"), F.lit(nf))
    feature = F.get(feats, S.target_feature(F.col("t"), F.lit(nf)))
    key = S.forecast_key(feature)
    return ex.select("at", feature.alias("feature"), S.key_pollutant(key).alias("pollutant"),
                     S.key_station(key).alias("station"), S.hour_label(step + 1).alias("hour"),
                     S.add_hours(F.col("at"), step + 1).alias("timestamp"), "value")


def history(filled: DataFrame, series: Sequence[tuple[str, str]], T: int = K.TRAINING_HOURS,
            ts: str = "ts", station: str = "station", indicator: str = "indicator") -> DataFrame:
    """Last ``T`` values per series with their own timestamps.

    Long output ``(feature, pollutant, station, hour, timestamp, value)``;
    ``hour_1`` is the oldest of the T rows.
    """
    stamps = tail_timestamps(filled, T, ts)
    # j in time order, newest = T: a literal map over the (at most T) tail timestamps, no join
    first_j = T - len(stamps) + 1
    j_of = F.create_map(*[x for j, v in enumerate(stamps, first_j) for x in (S.ts_lit(v), F.lit(j))])
    h = _tail(filled, stamps, ts).withColumn("j", j_of[F.col(ts)] if stamps else F.lit(None).cast("int"))
    feature = S.series_key(indicator, station)
    key = S.forecast_key(feature)
    return h.select(feature.alias("feature"), S.key_pollutant(key).alias("pollutant"),
                    S.key_station(key).alias("station"), S.hour_label(F.col("j")).alias("hour"),
                    F.col(ts).alias("timestamp"), F.col("value"))


POINT = StructType([StructField("value", DoubleType()), StructField("timestamp", StringType())])
BLOCK = MapType(StringType(), MapType(StringType(), POINT))
DOC_SCHEMA = StructType([StructField("prediction_timestamp", StringType()),
                         StructField("predictions", BLOCK),
                         StructField("historical_data", BLOCK)])


def forecast_document(pred_long: DataFrame, hist_long: DataFrame, at) -> DataFrame:
    """One-row forecast document (F17); both blocks keyed ``<pollutant>_<station>``.

    One aggregate over the tagged union of both blocks (no join).  The
    document is one logical value, bounded by #series x (n + T) points.
    """
    at_col = S.ts_lit(at)
    cols = ["pollutant", "station", "hour", "timestamp", "value"]
    u = (pred_long.select(F.lit(True).alias("_p"), *cols)
         .unionByName(hist_long.select(F.lit(False).alias("_p"), *cols)))
    point = F.struct(F.col("value"), S.iso_local("timestamp").alias("timestamp"))
    inner = u.groupBy("_p", F.concat_ws("_", "pollutant", "station").alias("k")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("hour"), point))).alias("m"))
    entry = F.struct("k", "m")
    # collect_list skips the NULLs of the other block
    return inner.agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_p"), entry))).alias("predictions"),
        F.map_from_entries(F.collect_list(F.when(~F.col("_p"), entry))).alias("historical_data"),
    ).select(S.iso_local(at_col).alias("prediction_timestamp"), "predictions", "historical_data")


def flatten_forecast(doc: DataFrame, block: str = "predictions") -> DataFrame:
    """Forecast document -> ``(timestamp, pollutant, value, hour, station)``.

    Keys split at the first ``_`` (``Unknown Station`` when none); timestamps
    parsed leniently and bad ones dropped.
    """
    outer = doc.select(F.explode(block).alias("key", "inner"))
    rows = outer.select("key", F.explode("inner").alias("hour", "p"))
    out = rows.select(F.try_to_timestamp(F.col("p.timestamp")).cast("timestamp_ntz").alias("timestamp"),
                      S.key_pollutant("key").alias("pollutant"), F.col("p.value").alias("value"),
                      F.col("hour"), S.key_station("key").alias("station"))
    return out.dropna(subset=["timestamp"])


def station_snapshot(hist_long: DataFrame, stations: DataFrame) -> DataFrame:
    """Latest values per station pivoted by pollutant + coordinates.

    Rows at the table-wide latest timestamp (W8), one aggregate per station
    with a value per pollutant, left join from the station dimension: a
    station without rows keeps NULLs.
    """
    latest = rows_at_latest(hist_long, "timestamp")
    of = lambda p: F.max(F.when(F.col("pollutant") == p, F.col("value")))  # noqa: E731 - one row per key at one time
    wide = latest.groupBy("station").agg(F.max("timestamp").alias("timestamp"), of("Nitrogen dioxide").alias("no2"),
                                         of("PM10").alias("pm10"), of("PM2.5").alias("pm25"))
    return stations.select("station", "latitude", "longitude").join(wide, "station", "left")


def map_rows(snapshot: DataFrame) -> DataFrame:
    """Per-station map record: defaults for absent values and a PM10 colour."""
    pm10 = S.with_default("pm10", K.MAP_DEFAULT_PM10)
    return snapshot.select("station", "latitude", "longitude", "timestamp", pm10.alias("pm10"),
                           S.with_default("pm25", K.MAP_DEFAULT_PM25).alias("pm25"),
                           S.with_default("no2", K.MAP_DEFAULT_NO2).alias("no2"),
                           S.pm10_colour(pm10).alias("colour"), F.lit(30).alias("size"))


def data_status(rows: DataFrame, members: dict[str, Column], n_columns: int, T: int = K.TRAINING_HOURS,
                n: int = K.N_STEPS) -> DataFrame:
    """One row per dataset: available, rows, columns, sufficient, min_required.

    ``members`` says of each dataset which of ``rows`` belong to it; all are
    counted by one aggregate.  Training needs T + n + 10 rows, prediction T + n.
    """
    need = {name: T + n + (K.TRAIN_EXTRA_ROWS if name == "training" else 0) for name in members}
    counts = rows.agg(*[F.count_if(c).alias(name) for name, c in members.items()])
    each = counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("dataset"), F.col(name).alias("n_rows"),
                                                     F.lit(need[name]).alias("min_required")) for name in members])))
    return each.select("dataset", (F.col("n_rows") > 0).alias("available"), "n_rows", F.lit(n_columns).alias("n_columns"),
                       "min_required", (F.col("n_rows") >= F.col("min_required")).alias("sufficient"))
