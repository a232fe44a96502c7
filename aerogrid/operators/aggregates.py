"""Aggregation, dedup and pivot operators.

Dedup is written as a grouped ``min_by`` / ``max_by`` rather than a
``row_number`` window: the aggregate runs partial (map-side) before the
shuffle, so a hot key collapses to one row per map task instead of landing
whole in one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    ByteType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    TimestampNTZType,
    TimestampType,
)

from aerogrid.functions.scalars import series_key


_INT = (ByteType, ShortType, IntegerType)
_FIXED = (*_INT, LongType, FloatType, DoubleType, BooleanType, DateType, TimestampType, TimestampNTZType, DecimalType)
_LEAST = -(1 << 63)


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _packed_order(df: DataFrame, order: Sequence[str]) -> Column | None:
    """One fixed-width column that sorts like ``order`` (nulls first): a whole
    number itself, or an int and a whole number as one decimal.  None for others."""
    kinds = [df.schema[c].dataType for c in order]
    if not all(isinstance(k, (*_INT, LongType)) for k in kinds) or len(order) > 2 or not all(isinstance(k, _INT) for k in kinds[:-1]):
        return None
    last = F.coalesce(F.col(order[-1]).cast("long"), F.lit(_LEAST))
    if len(order) == 1:
        return last
    head = F.coalesce(F.col(order[0]).cast("long"), F.lit(-(1 << 32))).cast("decimal(10,0)")
    return head * F.lit(str(1 << 64)).cast("decimal(20,0)") + last.cast("decimal(19,0)")


def _dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: bool) -> DataFrame:
    """One row per key.  Where all other columns have a fixed width, each is
    picked by one packed order column, which Spark hash-aggregates; with texts
    among them the row is picked as a struct, which it sorts."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    rank = _packed_order(df, order)
    if rest and rank is not None and all(isinstance(df.schema[c].dataType, _FIXED) for c in rest):
        return df.groupBy(*keys).agg(*[pick(F.col(c), rank).alias(c) for c in rest])
    payload = F.struct(*[F.col(c) for c in rest])
    agg = df.groupBy(*keys).agg(pick(payload, _order_struct(order)).alias("_row"))
    return agg.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("chunk_no", "seq")) -> DataFrame:
    """Keep the first row per key in arrival order ``order`` (A1, A2).

    Arrival order must be carried as columns (``chunk_no`` newest-first, then
    ``seq``) because Spark has no row order of its own.
    """
    return _dedup(df, keys, order, first=True)


def dedup_last(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("seq",)) -> DataFrame:
    """Last-write-wins per key (A3)."""
    return _dedup(df, keys, order, first=False)


def collect_by_key(df: DataFrame, key: str, order: str, cols: Sequence[str], name: str = "rows") -> DataFrame:
    """Rows per key as one sorted array.

    The array is ordered by the first struct field (``order``).  The group is
    bounded by the per-key row count, so use it on deduplicated, windowed
    data (a fetch window per station), not on raw history.
    """
    st = F.struct(F.col(order), *[F.col(c) for c in cols if c != order])
    return df.groupBy(key).agg(F.array_sort(F.collect_list(st)).alias(name))


def collect_chunks(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str], size: int = 1000,
                   block: str = "day", name: str = "rows") -> DataFrame:
    """Rows per key as sorted arrays of at most ``size`` rows: ``(key, chunk, rows)``
    with chunks numbered from 0 in order (A4, S9 for a history of any length).

    ``order`` starts with a time.  Rows are numbered per key and day, days are
    offset by the rows of the key's earlier days (one row per key and day), so
    no window holds a key's whole history and no array is unbounded.
    """
    b = df.withColumn("_b", F.date_trunc(block, F.col(order[0])))
    own = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1
    days = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = b.groupBy(key, "_b").agg(F.count("*").alias("_n")).select(
        F.col(key).alias("_k"), F.col("_b").alias("_d"), F.coalesce(F.sum("_n").over(days), F.lit(0)).alias("_off"))
    rows = b.withColumn("_r", own)
    rows = rows.join(off, rows[key].eqNullSafe(F.col("_k")) & rows["_b"].eqNullSafe(F.col("_d"))).withColumn("pos", F.col("_off") + F.col("_r"))
    st = F.struct("pos", *[F.col(c) for c in dict.fromkeys([*order, *cols])])
    return rows.groupBy(key, F.floor(F.col("pos") / size).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(st)).alias(name))


def profile(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Row count, min/max timestamp and column count in one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.min(ts).alias("min_ts"),
                  F.max(ts).alias("max_ts"),
                  F.lit(len(df.columns)).alias("n_columns"))


def to_wide(long: DataFrame, series: Sequence[tuple[str, str]], ts: str = "ts",
            station: str = "station", indicator: str = "indicator", value: str = "value") -> DataFrame:
    """Long -> wide ``ts`` + one column per ``<indicator>_<station>``.

    Pivot values are explicit (no extra job to discover them); the n-way
    outer merge of station tables becomes this single grouped pivot.
    """
    names = [f"{ind}_{st}" for st, ind in series]
    keyed = long.select(ts, series_key(indicator, station).alias("_series"), value)
    return keyed.groupBy(ts).pivot("_series", names).agg(F.first(value, ignorenulls=True))


def forecast_overview(pred: DataFrame, hist: DataFrame | None) -> DataFrame:
    """Historical points, predicted points, distinct pollutants and stations."""
    tagged = pred.select(F.lit(False).alias("_hist"), "pollutant", "station")
    if hist is not None:
        tagged = tagged.unionByName(hist.select(F.lit(True).alias("_hist"), "pollutant", "station"))
    is_pred = ~F.col("_hist")
    # one aggregate over the tagged union: no join of the two sides needed
    return tagged.agg(
        F.count(F.when(F.col("_hist"), 1)).alias("historical_points"),
        F.count(F.when(is_pred, 1)).alias("predicted_points"),
        F.count_distinct(F.when(is_pred, F.col("pollutant"))).alias("n_pollutants"),
        F.count_distinct(F.when(is_pred, F.col("station"))).alias("n_stations"))


def forecast_summary(pred: DataFrame) -> DataFrame:
    """Avg / max / min forecast per pollutant x station, 1 decimal."""
    return pred.groupBy("pollutant", "station").agg(
        F.round(F.avg("value"), 1).alias("avg_predicted"),
        F.round(F.max("value"), 1).alias("max_predicted"),
        F.round(F.min("value"), 1).alias("min_predicted"))


def compare_means(pred: DataFrame, hist: DataFrame) -> DataFrame:
    """Historical vs predicted mean per pollutant, change and % change (A10).

    A pollutant needs rows on both sides (inner join); % change is 0 when the
    historical mean is 0.
    """
    p = pred.groupBy("pollutant").agg(F.avg("value").alias("pred_avg"))
    h = hist.groupBy("pollutant").agg(F.avg("value").alias("hist_avg"))
    j = h.join(p, "pollutant", "inner")
    change = F.col("pred_avg") - F.col("hist_avg")
    return j.select("pollutant", "hist_avg", "pred_avg", change.alias("change"),
                    F.when(F.col("hist_avg") != 0, change / F.col("hist_avg") * 100.0)
                    .otherwise(F.lit(0.0)).alias("change_pct"))


def network_mean(snapshot: DataFrame, col: str = "pm10", default: float = 0.0) -> DataFrame:
    """Mean of a value across stations, absent -> ``default``."""
    return snapshot.agg(F.avg(F.coalesce(F.col(col), F.lit(default))).alias("avg_value"),
                        F.count(F.lit(1)).alias("n_stations"))


def label_list(df: DataFrame, col: str, sep: str = ", ", empty: str = "N/A") -> Column:
    """Sorted distinct values joined with ``sep``; ``empty`` when none."""
    joined = F.array_join(F.array_sort(F.collect_set(col)), sep)
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(empty))


def column_stats(long: DataFrame, idx: str, value: str) -> DataFrame:
    """Mean and population std per feature index; std 0 -> scale 1."""
    return long.groupBy(idx).agg(F.avg(value).alias("mean"),
                                 F.stddev_pop(value).alias("_std")).select(
        idx, "mean", F.when(F.col("_std") == 0, F.lit(1.0)).otherwise(F.col("_std")).alias("std"))


def regression_metrics(pairs: DataFrame, target: str = "target", y: str = "y",
                       yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE over all outputs; R2 per output then averaged (A14, A15),
    for the whole frame or for each group of ``by``.

    ``pairs`` is long: one row per (sample, target).  SStot = 0 gives R2 = 1
    when the fit is exact, else 0.
    """
    err = F.col(y) - F.col(yhat)
    # one pass: SStot = n * var_pop(y), which Spark merges with a stable
    # (Welford/Chan) update, so no second pass over centred values is needed
    per_target = pairs.groupBy(*by, target).agg(
        F.sum(err * err).alias("ss_res"),
        (F.var_pop(F.col(y)) * F.count(F.lit(1))).alias("ss_tot"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(err)).alias("s_abs"))
    r2 = per_target.select(
        *by, target, "ss_res", "n", "s_abs",
        F.when(F.col("ss_tot") == 0, F.when(F.col("ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.lit(1.0) - F.col("ss_res") / F.col("ss_tot")).alias("r2"))
    tot = r2.groupBy(*by).agg(F.sum("s_abs").alias("s_abs"), F.sum("ss_res").alias("ss_res"),
                 F.sum("n").alias("n"), F.avg("r2").alias("r2_score"))
    return tot.select(*by, (F.col("s_abs") / F.col("n")).alias("mae"),
                      (F.col("ss_res") / F.col("n")).alias("mse"),
                      F.sqrt(F.col("ss_res") / F.col("n")).alias("rmse"),
                      F.col("r2_score"))
