"""Many Lasso fits as one job: additive moments per key, fits per group.

Moments of shifted samples (count, sums, cross products) add up, so each
sample is read once, under one key: a stretch of the time axis (M6, M9, the
weekly retraining, whose windows overlap) or a region (SURVEY 7.3).  A group,
that is a model, is the sum of its keys' moments; its targets are solved in
slices, so one job fits every target of every group.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerogrid import constants as K
from aerogrid.functions.scalars import cyclic_time_features
from aerogrid.operators.aggregates import regression_metrics
from aerogrid.operators.joins import in_windows
from aerogrid.operators.windows import dense_index, window_arrays
from aerogrid.plans.lasso import _stack, coordinate_descent
from aerogrid.plans.samples import build_samples, time_split
from aerogrid.session import cut_lineage, discard, ship_package

HELD_BYTES = 64 << 20      # matrices that a task holds before it emits them
BLOCK_BYTES = 1 << 20      # one row of the moment table
SLICE_TARGETS = 16         # targets of one group solved together
MOMENTS = "key bigint, blk int, vals array<double>"
FITS = "grp bigint, target int, intercept double, coef array<double>"


class Shape(NamedTuple):
    """Width of the samples: ``d`` features, ``t`` targets, and the shift of both."""
    d: int
    t: int
    shift: np.ndarray

    @property
    def width(self) -> int:
        return self.d + self.t

    @property
    def block_rows(self) -> int:
        return max(1, BLOCK_BYTES // (8 * self.width))


def shape_of(samples: DataFrame, x: str = "x", y: str = "y") -> Shape:
    head = samples.select(x, y).first()
    if head is None:
        raise ValueError("no training samples")
    return Shape(len(head[x]), len(head[y]), np.concatenate([np.asarray(head[c], dtype=np.float64) for c in (x, y)]))


def _added(pdf: pd.DataFrame) -> np.ndarray:
    return np.sum(_stack(pdf["vals"]), axis=0)


def keyed_moments(samples: DataFrame, shape: Shape, key: str = "key", x: str = "x", y: str = "y") -> DataFrame:
    """``(key, blk, vals)``: per key the count and sums (blk -1) and blocks of
    rows of Z_x'Z, in one pass over ``samples``.

    A task emits what it holds when that passes ``HELD_BYTES``; partial sums
    are only more rows, so any number of keys may lie in one partition.  A key
    with a third of all rows still ships one matrix per task."""
    ship_package(samples.sparkSession)
    d, width, rb, shift = shape.d, shape.width, shape.block_rows, shape.shift
    most = max(1, HELD_BYTES // (8 * d * width))

    def emit(held: dict):
        rows = []
        for k, (n, s, m) in held.items():
            rows.append((k, -1, np.concatenate([[float(n)], s])))
            rows += [(k, b, m[b * rb:(b + 1) * rb].ravel()) for b in range(-(-d // rb))]
        return pd.DataFrame(rows, columns=["key", "blk", "vals"])

    def part(it):
        held: dict = {}
        for pdf in it:
            for k, rows in pdf.groupby(key):
                if k not in held and len(held) >= most:
                    yield emit(held)
                    held = {}
                Z = np.hstack([_stack(rows[x]), _stack(rows[y])]) - shift
                n, s, m = held.get(k, (0, 0.0, 0.0))
                held[k] = n + len(Z), s + Z.sum(axis=0), m + Z[:, :d].T @ Z
        if held:
            yield emit(held)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "blk": [pdf["blk"].iloc[0]], "vals": [_added(pdf)]})

    src = samples.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), x, y)
    return src.mapInPandas(part, MOMENTS).groupBy("key", "blk").applyInPandas(add, MOMENTS)


def fit_groups(moments: DataFrame, members: DataFrame, shape: Shape, alpha: float = K.LASSO_ALPHA) -> tuple[DataFrame, DataFrame]:
    """Scaled Lasso of every group: ``(grp, target, intercept, coef)`` and
    ``(grp, n, mean, std)``.

    ``members`` is ``(grp, key)``: the keys whose moments a group adds up.  A
    group's matrix is gathered once per slice of its targets."""
    d, t, width, rb = shape.d, shape.t, shape.width, shape.block_rows
    shift = shape.shift
    schema = "grp bigint, blk int, vals array<double>"

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "blk": [pdf["blk"].iloc[0]], "vals": [_added(pdf)]})

    whole = cut_lineage(moments.join(members, "key").select("grp", "blk", "vals").groupBy("grp", "blk").applyInPandas(add, schema), "grouped")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = {int(b): np.asarray(v, dtype=np.float64) for b, v in zip(pdf["blk"], pdf["vals"], strict=True)}
        head = blocks.pop(-1)
        n, s = int(round(head[0])), head[1:]
        m = np.vstack([blocks[b].reshape(-1, width) for b in sorted(blocks)]) - np.outer(s[:d], s) / n
        mean = shift + s / n
        std = np.sqrt(np.clip(np.diag(m[:, :d]) / n, 0.0, None))
        std[std == 0.0] = 1.0
        G, grp, part = m[:, :d] / np.outer(std, std), int(pdf["grp"].iloc[0]), int(pdf["slice"].iloc[0])
        rows = []
        if part == 0:
            rows = [(grp, -1, float(n), mean[:d]), (grp, -2, float(n), std)]
        for k in range(part * SLICE_TARGETS, min(t, (part + 1) * SLICE_TARGETS)):
            rows.append((grp, k, float(mean[d + k]), coordinate_descent(G, m[:, d + k] / std, alpha * n)))
        return pd.DataFrame(rows, columns=["grp", "target", "intercept", "coef"])

    slices = F.array(*[F.lit(i) for i in range(-(-t // SLICE_TARGETS))])
    done = cut_lineage(whole.withColumn("slice", F.explode(slices)).groupBy("grp", "slice").applyInPandas(solve, FITS), "grouped")
    discard(whole)
    stats = done.where("target < 0").groupBy("grp").agg(
        F.max("intercept").cast("bigint").alias("n"), F.max(F.when(F.col("target") == -1, F.col("coef"))).alias("mean"),
        F.max(F.when(F.col("target") == -2, F.col("coef"))).alias("std"))
    return done.where("target >= 0"), stats


def predict_groups(samples: DataFrame, coef: DataFrame, stats: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``(grp, sample_id, target, y, yhat)`` of ``samples`` ``(grp, sample_id,
    x, y)``, each by its group's model (M5): the model meets its group's rows
    in a cogroup, nothing is broadcast."""
    model = coef.join(stats.select("grp", "mean", "std"), "grp")

    def apply(rows: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(fits):
            return pd.DataFrame({"grp": [], "sample_id": [], "target": [], "y": [], "yhat": []})
        fits = fits.sort_values("target")
        X = (_stack(rows[x]) - np.asarray(fits["mean"].iloc[0])) / np.asarray(fits["std"].iloc[0])
        Y = X @ _stack(fits["coef"]).T + fits["intercept"].to_numpy()
        t = Y.shape[1]
        return pd.DataFrame({"grp": rows["grp"].iloc[0], "sample_id": np.repeat(rows["sample_id"].to_numpy(), t),
                             "target": np.tile(np.arange(t), len(rows)), "y": _stack(rows[y]).ravel(), "yhat": Y.ravel()})

    return samples.groupBy("grp").cogroup(model.groupBy("grp")).applyInPandas(
        apply, "grp bigint, sample_id bigint, target int, y double, yhat double")


# -- weekly retraining (M6, M9) ----------------------------------------------
class Runs(NamedTuple):
    spans: DataFrame      # grp, lo, mid, hi: training samples lo..mid-1, validation samples mid..hi-1
    coef: DataFrame       # grp, target, intercept, coef
    stats: DataFrame      # grp, n, mean, std
    metrics: DataFrame    # grp, mae, mse, rmse, r2_score, training_samples, validation_samples


def run_spans(filled: DataFrame, windows: DataFrame, T: int, n: int, ts: str = "ts") -> DataFrame:
    """Sample numbers of every window ``(grp, start, end)``: its rows in time
    order, less the first T and the last n - 1, split as M2 does."""
    idx = dense_index(filled, ts)
    ends = in_windows(idx, windows, ts).groupBy("grp").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    total = F.col("b") - F.col("a") + 2 - n - T
    held = F.floor(total / (K.N_SPLITS + 1))
    lo = F.col("a")
    return ends.select("grp", lo.alias("lo"), (lo + total - held).alias("mid"), (lo + total).alias("hi"), total.alias("samples"))


def train_windows(filled: DataFrame, series: Sequence[tuple[str, str]], windows: DataFrame, T: int = K.TRAINING_HOURS,
                  n: int = K.N_STEPS, alpha: float = K.LASSO_ALPHA) -> Runs:
    """Train one model per window of ``windows`` ``(grp, start, end)`` (M6, M9),
    both ends inclusive, as ``model.train`` does on the window's rows.

    One pass over the samples: the runs' borders cut the time axis into
    stretches, every stretch has its moments once, and a run adds up the
    stretches it covers, however many runs overlap there.  A window too short
    for one sample per fold raises."""
    spans = cut_lineage(run_spans(filled, windows, T, n), "spans")
    short = spans.where(F.col("samples") < K.N_SPLITS + 1).agg(F.count("*").alias("n"), F.min("samples").alias("least")).first()
    found = spans.count()
    if short["n"] or found < windows.count():
        raise ValueError(f"Cannot have number of folds={K.N_SPLITS + 1} greater than the number of samples={short['least'] or 0}.")
    # two or three numbers per run
    borders = sorted({v for r in spans.select("lo", "mid", "hi").collect() for v in r})
    samples = cut_lineage(build_samples(filled, series, T, n), "samples")
    keyed = samples.withColumn("key", _stretch(F.col("sample_id"), samples.sparkSession, borders))
    at = {v: i + 1 for i, v in enumerate(borders)}
    table = samples.sparkSession.createDataFrame([(v, i) for v, i in at.items()], "border bigint, stretch bigint")

    def stretches(a: str, b: str) -> DataFrame:
        one = spans.join(table.select(F.col("border").alias(a), F.col("stretch").alias("_a")), a)
        two = one.join(table.select(F.col("border").alias(b), F.col("stretch").alias("_b")), b)
        return two.where("_a < _b").select("grp", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)).alias("key"))

    shape = shape_of(samples)
    coef, stats = fit_groups(keyed_moments(keyed, shape), stretches("lo", "mid"), shape, alpha)
    validation = keyed.join(stretches("mid", "hi"), "key").select("grp", "sample_id", "x", "y")
    pairs = predict_groups(validation, coef, stats)
    metrics = regression_metrics(pairs, by=["grp"]).join(spans.select(
        "grp", (F.col("mid") - F.col("lo")).cast("double").alias("training_samples"),
        (F.col("hi") - F.col("mid")).cast("double").alias("validation_samples")), "grp")
    return Runs(spans, coef, stats, cut_lineage(metrics, "run-metrics"))


def _stretch(sample_id, spark, borders: list[int]):
    """Number of borders up to a sample: a binary search over one broadcast array of whole numbers."""
    ship_package(spark)
    held = spark.sparkContext.broadcast(np.array(borders, np.int64))

    @F.pandas_udf("bigint")
    def find(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, ids.to_numpy(), side="right"))

    return find(sample_id)


# -- one model per region ---------------------------------------
def region_samples(filled: DataFrame, members: Sequence[str], region: str = "station", member: str = "indicator", ts: str = "ts",
                   value: str = "value", T: int = K.TRAINING_HOURS, n: int = K.N_STEPS) -> DataFrame:
    """``(region, sample_id, ts, x, y)``: samples as M1 builds them, within each
    region of its own series (``members`` in model order).  Regions are data:
    the plan is the same for any number of them."""
    order = F.array_position(F.array(*[F.lit(m) for m in members]), F.col(member))
    vec = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("i"), F.col(value).alias("v")))), lambda c: c["v"])
    rows = filled.where(F.col(member).isin(list(members))).groupBy(region, ts).agg(vec.alias("vec")).where(F.size("vec") == len(members))
    rows = rows.join(dense_index(filled, ts), ts).select(region, ts, "idx", "vec", F.array(*cyclic_time_features(ts)).alias("tf"))
    arr = window_arrays(rows, [region], "idx", ["vec"], before=T, after=n)
    return arr.select(F.col(region).alias("region"), (F.col("idx") - T).alias("sample_id"), ts,
                      F.concat(F.flatten(F.col("lag.vec")), F.col("tf")).alias("x"), F.flatten(F.col("lead.vec")).alias("y"))


def fit_regions(samples: DataFrame, alpha: float = K.LASSO_ALPHA) -> tuple[DataFrame, DataFrame]:
    """One Lasso per region from the training part of its samples:
    ``(region, target, intercept, coef)`` and ``(region, n, mean, std)``."""
    landed = cut_lineage(samples, "region-samples")
    split = time_split(landed, landed.select("sample_id").distinct().count())
    train = split.where(~F.col("is_validation"))
    # regions numbered by the data, one row each
    names = cut_lineage(train.select("region").distinct().withColumn("grp", F.xxhash64("region")), "regions")
    keyed = train.withColumn("key", F.xxhash64("region"))
    shape = shape_of(train)
    coef, stats = fit_groups(keyed_moments(keyed, shape), names.select("grp", F.col("grp").alias("key")), shape, alpha)
    return coef.join(names, "grp").drop("grp"), stats.join(names, "grp").drop("grp")
