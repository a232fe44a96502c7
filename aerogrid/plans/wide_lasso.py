"""Lasso of any width: working sets, and descent over blocks of features (M4).

``lasso.moments`` holds a d x d matrix, which ends at ``MAX_WIDTH`` features.
Here no matrix over all features exists.  For a group of targets a round is

1. one pass over the samples for the gradient ``X'(y - X w)`` of every feature
   (d values for each target, summed per block of features, where the features
   that break the optimality conditions are picked, strongest first);
2. these join the target's working set; the Gram matrix over the working sets
   of the targets still open is summed in a second pass, and each target is
   solved on its own set by a Spark task.  Targets whose sets together exceed a
   block take a pass each.

The fit ends when a pass over *all* features finds no broken condition, so it
is exact whatever was screened out before.  A working set wider than a block
is solved block by block with the other blocks held fixed, which decreases the
objective at each step and ends at the same conditions.

What a task holds is bounded by ``GRADIENT_BYTES`` (gradients of a group of
targets), one block's Gram and a slice of samples; the driver holds the
scaler, one block's Gram and the coefficients other than 0.

Inputs: ``x`` and ``y`` are arrays of fixed widths ``d`` and ``t``.  A null or
a wrong width raises ``ValueError`` in the task; no samples raise ``ValueError``.
Constant features get no weight.  Equal features share their weight in an
unspecified way, as in any Lasso.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerogrid.plans import lasso
from aerogrid.session import ship_package

GRADIENT_BYTES = 64 << 20   # gradients of one group of targets in a task
SLICE_BYTES = 16 << 20      # samples turned into a matrix at a time
GROW = 32                   # features a target may add in the first round, doubled each round
SLACK = 1e-6                # conditions hold within this share of the penalty

SPARSE_SCHEMA = "target int, idx int, coef double"


@dataclass
class WideFit:
    """Scaler (``mean``, ``std``), intercept per target, and the coefficients
    other than 0 as ``(target, idx, coef)``."""

    n: int
    mean: np.ndarray
    std: np.ndarray
    intercept: np.ndarray
    coef: DataFrame
    rounds: int


def _matrix(col: pa.ListArray, width: int) -> np.ndarray:
    flat = col.flatten()
    if col.null_count or flat.null_count or len(flat) != len(col) * width:
        raise ValueError(f"a sample is null or not {width} wide")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(col), width)


def _summed(src: DataFrame, d: int, t: int, fold, rows: int, width: int, finish, schema: str) -> DataFrame:
    """The sum over all samples of ``fold(X, Y)`` (rows x width), in blocks of
    rows; ``finish(first_row, block)`` turns a summed block into output rows."""
    spark = src.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rb = int(min(max(1, lasso.MERGE_BYTES // (8 * width * parts)), max(1, -(-rows // parts))))
    step = max(1, SLICE_BYTES // (8 * (d + t)))

    def part(batches):
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                cut = batch.slice(lo, step)
                m = fold(_matrix(cut.column(0), d), _matrix(cut.column(1), t))
                total = m if total is None else np.add(total, m, out=total)
        if total is not None:
            for b in range(-(-rows // rb)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([total[b * rb:(b + 1) * rb].ravel()], pa.list_(pa.float64()))],
                    names=["blk", "vals"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.vstack(list(pdf["vals"])), axis=0).reshape(-1, width)
        return finish(int(pdf["blk"].iloc[0]) * rb, total)

    partial = src.coalesce(parts).mapInArrow(part, "blk int, vals array<double>")
    return partial.groupBy("blk").applyInPandas(add, schema)


def _rows(first: int, block: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"row": np.arange(first, first + len(block), dtype=np.int32), "vals": list(block)})


def _collected(summed: DataFrame) -> np.ndarray:
    return np.vstack(list(summed.toPandas().sort_values("row")["vals"]))


def column_moments(src: DataFrame, d: int, t: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of samples, mean and population std of every x and y column.

    Sums are taken about one sample, so they are free of cancellation."""
    head = src.first()
    if head is None:
        raise ValueError("no training samples")
    shift = np.concatenate([np.asarray(head[0], dtype=np.float64), np.asarray(head[1], dtype=np.float64)])
    if len(shift) != d + t:
        raise ValueError(f"sample width {len(shift)} != d + t = {d + t}")

    def fold(X, Y):
        Z = np.hstack([X, Y]) - shift
        return np.vstack([np.column_stack([Z.sum(axis=0), (Z * Z).sum(axis=0)]), [[len(Z), 0.0]]])

    m = _collected(_summed(src, d, t, fold, d + t + 1, 2, _rows, "row int, vals array<double>"))
    n = int(round(m[-1, 0]))
    mean = m[:-1, 0] / n
    return n, shift + mean, np.sqrt(np.clip(m[:-1, 1] / n - mean * mean, 0.0, None))


def _residual(X, Y, idx, W):
    return Y if len(idx) == 0 else Y - X[:, idx] @ W


class _Group:
    """One group of targets on centred (and scaled) samples."""

    def __init__(self, src, d, t, targets, centre, scale, y_mean, lam):
        self.src, self.d, self.t, self.targets, self.lam = src, d, t, targets, lam
        self.shared = src.sparkSession.sparkContext.broadcast((centre, scale, y_mean[targets]))

    def _prepare(self):
        shared, targets = self.shared, self.targets

        def prepare(X, Y):
            centre, scale, base = shared.value
            return (X - centre) / scale, Y[:, targets] - base
        return prepare

    def broken(self, idx: np.ndarray, W: np.ndarray, most: int) -> DataFrame:
        """``(target, idx, excess)`` of conditions broken at coefficients ``W``
        of the features ``idx``: at most ``most`` for a target, strongest
        first.  The rest is found again in the next round."""
        prepare, lam, k = self._prepare(), self.lam, len(self.targets)
        at = {int(j): i for i, j in enumerate(idx)}

        def fold(X, Y):
            Xs, Ys = prepare(X, Y)
            return Xs.T @ _residual(Xs, Ys, idx, W)

        def finish(first, g):
            over = np.abs(g) - lam                                   # a coefficient of 0: |gradient| <= lam
            for j in range(first, first + len(g)):
                if j in at:
                    w = W[at[j]]
                    over[j - first] = np.where(w != 0, np.abs(g[j - first] - lam * np.sign(w)), over[j - first])
            row, target = np.nonzero(over > SLACK * lam)
            return pd.DataFrame({"target": target.astype(np.int32), "idx": (first + row).astype(np.int32),
                                 "excess": over[row, target]})

        found = _summed(self.src, self.d, self.t, fold, self.d, k, finish, "target int, idx int, excess double")
        order = Window.partitionBy("target").orderBy(F.desc("excess"), "idx")
        return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")

    def gram(self, block: np.ndarray, which: np.ndarray, others: np.ndarray, W: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gram matrix of the features ``block`` and their products with the
        residual that the ``others`` leave of the targets ``which``."""
        prepare, b = self._prepare(), len(block)

        def fold(X, Y):
            Xs, Ys = prepare(X, Y)
            XB = Xs[:, block]
            return XB.T @ np.hstack([XB, _residual(Xs, Ys[:, which], others, W)])

        width = b + len(which)
        m = _collected(_summed(self.src, self.d, self.t, fold, b, width, _rows, "row int, vals array<double>"))
        return m[:, :b], m[:, b:]

    def _together(self, sets: dict[int, np.ndarray], width: int):
        """Targets whose working sets have a union of at most ``width`` features;
        a target with a wider set comes alone."""
        part, union = [], np.empty(0, dtype=np.int64)
        for k, s in sorted(sets.items()):
            joint = np.union1d(union, s)
            if part and len(joint) > width:
                yield part, union
                part, joint = [], s
            part, union = [*part, k], joint
        if part:
            yield part, union

    def _solve(self, part: list[int], union: np.ndarray, sets: dict, coef: dict) -> dict[int, np.ndarray]:
        """The Lasso of each target of ``part`` on its own working set."""
        none = np.empty(0, dtype=np.int64)
        G, C = self.gram(union, np.array(part), none, np.empty((0, len(part))))
        spark, lam = self.src.sparkSession, self.lam
        shared = spark.sparkContext.broadcast((G, C, [np.searchsorted(union, sets[k]) for k in part], [coef[k] for k in part]))

        def run(it):
            Gm, Cm, at, start = shared.value
            for pdf in it:
                yield pd.DataFrame({"id": pdf["id"], "w": [
                    lasso.coordinate_descent(Gm[np.ix_(at[i], at[i])], Cm[at[i], i], lam, start=start[i]).tolist() for i in pdf["id"]]})

        tasks = max(1, min(len(part), spark.sparkContext.defaultParallelism))
        solved = spark.range(0, len(part), 1, tasks).mapInPandas(run, "id long, w array<double>").toPandas()
        return {part[i]: np.asarray(w, dtype=np.float64) for i, w in zip(solved["id"], solved["w"])}

    def _descend(self, k: int, s: np.ndarray, w: np.ndarray, width: int) -> np.ndarray:
        """One turn over the blocks of a working set wider than ``width``."""
        w = w.copy()
        for lo in range(0, len(s), width):
            inside = np.zeros(len(s), dtype=bool)
            inside[lo:lo + width] = True
            G, C = self.gram(s[inside], np.array([k]), s[~inside], w[~inside, None])
            w[inside] = lasso.coordinate_descent(G, C[:, 0], self.lam, start=w[inside])
        return w

    def fit(self, width: int, max_rounds: int) -> tuple[np.ndarray, np.ndarray, int]:
        sets = {k: np.empty(0, dtype=np.int64) for k in range(len(self.targets))}
        coef = {k: np.empty(0) for k in sets}
        most = GROW
        for done in range(max_rounds):
            idx = np.unique(np.concatenate([sets[k][coef[k] != 0] for k in sets]))
            W = np.zeros((len(idx), len(sets)))
            for k, s in sets.items():
                on = coef[k] != 0
                W[np.searchsorted(idx, s[on]), k] = coef[k][on]
            found = self.broken(idx, W, most).select("target", "idx").toPandas()
            if found.empty:
                return idx, W, done
            open_sets = {}
            for k, new in found.groupby("target")["idx"]:
                k, s, w = int(k), sets[k], coef[k]
                if len(np.union1d(s, new)) > width:      # features without weight leave a set that has grown too wide
                    s, w = s[w != 0], w[w != 0]
                sets[k] = open_sets[k] = np.union1d(s, new)
                coef[k] = np.zeros(len(sets[k]))
                coef[k][np.searchsorted(sets[k], s)] = w
            for part, union in self._together(open_sets, width):
                if len(union) <= width:
                    coef.update(self._solve(part, union, sets, coef))
                else:
                    coef[part[0]] = self._descend(part[0], sets[part[0]], coef[part[0]], width)
            most *= 2
        raise RuntimeError(f"conditions still broken after {max_rounds} rounds for targets {self.targets.tolist()}")


def _groups(d: int, t: int) -> list[np.ndarray]:
    size = int(min(t, lasso.MAX_WIDTH, max(1, GRADIENT_BYTES // (8 * d))))
    return [np.arange(lo, min(lo + size, t)) for lo in range(0, t, size)]


def fit_wide(spark: SparkSession, train: DataFrame, d: int, t: int, alpha: float = 1.0, x: str = "x", y: str = "y",
             scaled: bool = True, width: int = lasso.MAX_WIDTH, max_rounds: int = 200) -> WideFit:
    """Multi-target Lasso for any number of features and targets.

    ``scaled``: on standardised features, as ``lasso.fit_scaled_lasso``, else
    on x as given, as ``lasso.fit_lasso``.  ``train`` is read twice a round;
    pass a landed frame.
    """
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    ship_package(spark)
    src = train.select(x, y)
    n, mean, std = column_moments(src, d, t)
    centre, y_mean = mean[:d], mean[d:]
    std = np.where(std[:d] == 0.0, 1.0, std[:d])
    scale = std if scaled else np.ones(d)
    rows, intercept, rounds = [], y_mean.copy(), 0
    for targets in _groups(d, t):
        idx, W, done = _Group(src, d, t, targets, centre, scale, y_mean, alpha * n).fit(width, max_rounds)
        rounds = max(rounds, done)
        if not scaled:
            intercept[targets] -= centre[idx] @ W
        at, k = np.nonzero(W)
        rows.append(pd.DataFrame({"target": targets[k].astype(np.int32), "idx": idx[at].astype(np.int32), "coef": W[at, k]}))
    coef = spark.createDataFrame(pa.Table.from_pandas(pd.concat(rows, ignore_index=True), preserve_index=False), SPARSE_SCHEMA)
    return WideFit(n, centre, std, intercept, coef, rounds)


def dense_coef(spark: SparkSession, fit: WideFit, d: int) -> DataFrame:
    """The fit as ``lasso.COEF_SCHEMA``: one array of d coefficients a target."""
    base = spark.createDataFrame(pa.table({"target": pa.array(range(len(fit.intercept)), pa.int32()),
                                           "intercept": pa.array(fit.intercept)}), "target int, intercept double")
    held = fit.coef.groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct("idx", "coef"))).alias("_m"))
    value = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                        lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return base.join(held, "target", "left").select("target", "intercept", value.alias("coef"))


def broken_conditions(train: DataFrame, fit: WideFit, d: int, t: int, alpha: float = 1.0, x: str = "x",
                      y: str = "y", scaled: bool = True) -> DataFrame:
    """``(target, n_broken)`` for every target: optimality conditions that the
    stored coefficients break, from one pass over the samples per group."""
    spark = train.sparkSession
    src, pdf = train.select(x, y), fit.coef.toPandas()
    _, mean, _ = column_moments(src, d, t)
    scale = fit.std if scaled else np.ones(d)
    out = None
    for targets in _groups(d, t):
        mine = pdf[pdf["target"].isin(targets)]
        idx = np.unique(mine["idx"].to_numpy(dtype=np.int64))
        W = np.zeros((len(idx), len(targets)))
        W[np.searchsorted(idx, mine["idx"]), mine["target"].to_numpy() - targets[0]] = mine["coef"]
        group = _Group(src, d, t, targets, fit.mean, scale, mean[d:], alpha * fit.n)
        n_broken = group.broken(idx, W, d).groupBy((F.col("target") + int(targets[0])).alias("target")).agg(
            F.count("*").alias("n_broken"))
        out = n_broken if out is None else out.unionByName(n_broken)
    every = spark.range(t).select(F.col("id").cast("int").alias("target"))
    return every.join(out, "target", "left").select("target", F.coalesce("n_broken", F.lit(0)).alias("n_broken"))
