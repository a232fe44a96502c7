"""Supervised samples, time split and scaling.

A sample at row i (rows = distinct timestamps of the dense grid in time order)
has x = the T rows before i flattened time-major / feature-minor, followed by
the four cyclic time features of row i, and y = rows i..i+n-1 flattened the
same way.  ``sample_id`` = i - T.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerogrid import constants as K
from aerogrid.functions.scalars import cyclic_time_features, series_key
from aerogrid.operators.aggregates import column_stats
from aerogrid.operators.windows import window_arrays, with_row_index


def features_table(spark: SparkSession, series: Sequence[tuple[str, str]]) -> DataFrame:
    """``features(feature_idx, station, indicator, feature)`` in model order."""
    rows = [(i, s, ind, f"{ind}_{s}") for i, (s, ind) in enumerate(series)]
    return spark.createDataFrame(rows, "feature_idx int, station string, indicator string, feature string")


def feature_index_column(series: Sequence[tuple[str, str]], station: str = "station",
                         indicator: str = "indicator"):
    """feature_idx as an expression over a literal map (no join)."""
    m = F.create_map(*[x for i, (s, ind) in enumerate(series)
                       for x in (F.lit(f"{ind}_{s}"), F.lit(i))])
    return m[series_key(indicator, station)]


def wide_rows(filled: DataFrame, series: Sequence[tuple[str, str]], ts: str = "ts",
              value: str = "value") -> DataFrame:
    """One row per timestamp: ``vec`` = values in feature order (group size = #series)."""
    fi = feature_index_column(series)
    per_ts = filled.select(ts, fi.alias("_fi"), value).where(F.col("_fi").isNotNull()).groupBy(ts).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_fi"), F.col(value)))).alias("_cells"))
    n = len(series)
    names = F.array(*[F.lit(f"{ind}_{s}") for s, ind in series])
    # after the fills a NULL is left only in a series with no value at all (Q6)
    first_null = F.array_position(F.transform("vec", lambda v: v.isNull()), True).cast("int")
    return per_ts.select(ts, F.col("_cells").getField(value).alias("vec")).withColumn(
        "vec", F.when(F.size("vec") != n, F.raise_error(
            F.concat(F.lit("incomplete row at "), F.col(ts).cast("string"))))
        .when(first_null > 0, F.raise_error(
            F.concat(F.lit("series with no observed value: "), F.element_at(names, first_null))))
        .otherwise(F.col("vec")))


def build_samples(filled: DataFrame, series: Sequence[tuple[str, str]], T: int = K.TRAINING_HOURS,
                  n: int = K.N_STEPS, ts: str = "ts", block_rows: int = 256) -> DataFrame:
    """``samples(sample_id, ts, x array<double>, y array<double>)`` (M1).

    Lag / lead arrays come from ``window_arrays`` (blocked with a halo), so
    the sample build is spread over N / block_rows independent windows.
    """
    rows = with_row_index(wide_rows(filled, series, ts), ts)
    rows = rows.select(ts, "idx", "vec", F.array(*cyclic_time_features(ts)).alias("tf"))
    arr = window_arrays(rows, [], "idx", ["vec"], before=T, after=n, block_rows=block_rows)
    return arr.select(
        (F.col("idx") - T).alias("sample_id"), ts,
        F.concat(F.flatten(F.col("lag.vec")), F.col("tf")).alias("x"),
        F.flatten(F.col("lead.vec")).alias("y"))


def require_samples(samples: DataFrame) -> int:
    n = samples.count()
    if n == 0:
        raise ValueError("not enough rows to build a single sample (need T + n rows)")
    return n


def time_split(samples: DataFrame, n_samples: int, n_splits: int = K.N_SPLITS) -> DataFrame:
    """Last fold of an expanding time split (M2): adds ``is_validation``.

    Validation = the last floor(N / (n_splits + 1)) samples by ``sample_id``.
    """
    if n_samples < n_splits + 1:
        raise ValueError(f"Cannot have number of folds={n_splits + 1} greater than the number of "
                         f"samples={n_samples}.")
    test_size = n_samples // (n_splits + 1)
    return samples.withColumn("is_validation", F.col("sample_id") >= F.lit(n_samples - test_size))


def fit_scaler(train: DataFrame, x: str = "x") -> DataFrame:
    """Per-feature mean and population std; std 0 -> 1.

    ``posexplode`` + grouped ``avg``/``stddev_pop``: partial aggregation per
    map task, a numerically stable merge, d output rows.
    """
    ex = train.select(F.posexplode(x).alias("idx", "v"))
    return column_stats(ex, "idx", "v")


def scaler_arrays(scaler: DataFrame) -> tuple[list[float], list[float]]:
    """Scaler as two short arrays (d values each, bounded by the model width)."""
    rows = scaler.orderBy("idx").collect()
    return [r["mean"] for r in rows], [r["std"] for r in rows]


def scale(samples: DataFrame, mean: Sequence[float], std: Sequence[float], x: str = "x") -> DataFrame:
    """(x - mean) / std element-wise with the train statistics (M3)."""
    m = F.array(*[F.lit(float(v)) for v in mean])
    s = F.array(*[F.lit(float(v)) for v in std])
    centred = F.zip_with(F.col(x), m, lambda a, b: a - b)
    return samples.withColumn(x, F.zip_with(centred, s, lambda a, b: a / b))
