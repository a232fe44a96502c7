"""Multi-target Lasso as Spark jobs (M4, M5).

Objective per target t:  (1 / 2N) ||y_t - b_t - X w_t||^2 + alpha ||w_t||_1
with a free intercept, i.e. the scikit-learn ``Lasso`` objective.

Fit = one pass over the samples.  Each partition forms shifted moments
(n, sum z, Z_x'Z) of z = [x | y] - shift with NumPy in ``mapInPandas``; the
shift is one sample row, so the centred moments suffer no cancellation.  The
partial matrices are summed per block of rows, with the block size chosen so
that one merge group stays under ``MERGE_BYTES`` whatever the number of map
partitions.  The d x (d + t) result is bounded by the model width, not by the
data.  The same moments give the scaler (mean, population std), so a scaled
fit needs no second pass.  Coordinate descent then runs per target: the
targets are a ``spark.range`` split over tasks, with the Gram matrix shipped
as a broadcast variable (no shuffle).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from aerogrid.session import ship_package

MAX_WIDTH = 4096  # d and t bound for the broadcast Gram (4096^2 doubles = 128 MiB)
MERGE_BYTES = 64 << 20  # memory of one merge group (partials of one row block)


def _stack(col: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in col]) if len(col) else np.empty((0, 0))


def moments(train: DataFrame, d: int, t: int, x: str = "x", y: str = "y") -> dict:
    """Count, means and centred cross-moments of x with [x | y] in one pass.

    Returns NumPy arrays on the driver: ``n``, ``mx`` (d), ``my`` (t),
    ``mxx`` = sum (x - mx)(x - mx)' (d x d), ``mxy`` = sum (x - mx)(y - my)'
    (d x t).
    """
    if d > MAX_WIDTH or t > MAX_WIDTH:
        raise ValueError(f"model too wide for a broadcast Gram: d={d}, t={t}")
    spark = train.sparkSession
    ship_package(spark)
    src = train.select(x, y)
    head = src.first()
    if head is None:
        raise ValueError("no training samples")
    shift = np.concatenate([np.asarray(head[x], dtype=np.float64), np.asarray(head[y], dtype=np.float64)])
    if shift.shape[0] != d + t:
        raise ValueError(f"sample width {shift.shape[0]} != d + t = {d + t}")
    width = d + t
    # bound the partials per merge group: at most ``parts`` rows of rb x width
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    src = src.coalesce(parts)
    rb = int(min(max(1, MERGE_BYTES // (8 * width * parts)), max(1, -(-d // parts))))

    def part(it):
        n = 0
        s = np.zeros(width)
        m = np.zeros((d, width))
        for pdf in it:
            if len(pdf) == 0:
                continue
            Z = np.hstack([_stack(pdf[x]), _stack(pdf[y])]) - shift
            n += Z.shape[0]
            s += Z.sum(axis=0)
            m += Z[:, :d].T @ Z
        if n == 0:
            return
        rows = [(-1, np.concatenate([[float(n)], s]).tolist())]
        rows += [(b, m[b * rb:(b + 1) * rb].ravel().tolist()) for b in range(-(-d // rb))]
        yield pd.DataFrame(rows, columns=["blk", "vals"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(_stack(pdf["vals"]), axis=0)
        return pd.DataFrame({"blk": [int(pdf["blk"].iloc[0])], "vals": [total.tolist()]})

    schema = "blk int, vals array<double>"
    summed = src.mapInPandas(part, schema).groupBy("blk").applyInPandas(add, schema).toPandas()
    blocks = {int(b): np.asarray(v, dtype=np.float64) for b, v in zip(summed["blk"], summed["vals"])}
    head_v = blocks.pop(-1)
    n = int(round(head_v[0]))
    s = head_v[1:]
    m = np.vstack([blocks[b].reshape(-1, width) for b in sorted(blocks)])
    mean_z = shift + s / n
    centred = m - np.outer(s[:d], s) / n
    return {"n": n, "mx": mean_z[:d], "my": mean_z[d:], "mxx": centred[:, :d], "mxy": centred[:, d:]}


def scaler_from_moments(st: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population std per feature; std 0 -> 1 (A13 from the moments)."""
    var = np.clip(np.diag(st["mxx"]) / st["n"], 0.0, None)
    std = np.sqrt(var)
    std[std == 0.0] = 1.0
    return st["mx"].copy(), std


CD_STAGES = (1e-2, 1e-3, 1e-4, 1e-6, 1e-8)


def _exact_on_support(G: np.ndarray, c: np.ndarray, lam: float, w: np.ndarray) -> np.ndarray | None:
    """Solve the Lasso exactly on the support and signs of ``w``.

    With support A and signs s the optimum satisfies G_AA w_A = c_A - lam s.
    The candidate is returned only if it meets all optimality (KKT)
    conditions: same signs, and |c_j - G_j. w| <= lam off the support.
    """
    A = np.flatnonzero(w)
    if A.size == 0:
        return None
    s = np.sign(w[A])
    rhs = c[A] - lam * s
    try:
        wA = np.linalg.solve(G[np.ix_(A, A)], rhs)
    except np.linalg.LinAlgError:
        return None
    if not np.all(np.isfinite(wA)) or np.any(np.sign(wA) != s):
        return None
    grad = c - G[:, A] @ wA
    slack = lam * 1e-9 + 1e-12
    if np.max(np.abs(grad[A] - lam * s)) > 10 * slack:
        return None
    off = np.ones(len(c), dtype=bool)
    off[A] = False
    if off.any() and np.max(np.abs(grad[off])) > lam + slack:
        return None
    out = np.zeros(len(c))
    out[A] = wA
    return out


def coordinate_descent(G: np.ndarray, c: np.ndarray, lam: float, tol: float = 1e-10,
                       max_iter: int = 20000, start: np.ndarray | None = None) -> np.ndarray:
    """Minimise 1/2 w'Gw - c'w + lam |w|_1 by cyclic coordinate descent, from
    ``start`` or from 0.

    Sweeps run over the active set until it settles, then a full sweep checks
    that no inactive coordinate wants to enter.  Tolerances tighten in stages;
    after each stage the problem is solved exactly on the current support
    (``_exact_on_support``), which ends the descent as soon as the support and
    signs are right.  Lag features are strongly correlated, so plain descent
    would need many sweeps to reach the same point.
    """
    d = len(c)
    w = np.zeros(d) if start is None else np.array(start, dtype=np.float64)
    Gw = G @ w
    diag = np.diag(G).copy()
    idx_all = np.flatnonzero(diag > 0)

    def sweep(indices):
        max_dw = 0.0
        for j in indices:
            rho = c[j] - Gw[j] + diag[j] * w[j]
            if rho > lam:
                new = (rho - lam) / diag[j]
            elif rho < -lam:
                new = (rho + lam) / diag[j]
            else:
                new = 0.0
            dw = new - w[j]
            if dw != 0.0:
                Gw[:] += dw * G[:, j]
                w[j] = new
                max_dw = max(max_dw, abs(dw))
        return max_dw

    for stage in (*[st for st in CD_STAGES if st > tol], tol):
        for _ in range(max_iter):
            dw = sweep(idx_all)
            scale = max(np.max(np.abs(w)), 1e-12)
            if dw <= stage * scale:
                break
            for _ in range(max_iter):
                active = np.flatnonzero(w != 0.0)
                if active.size == 0 or sweep(active) <= stage * scale:
                    break
        exact = _exact_on_support(G, c, lam, w)
        if exact is not None:
            return exact
    return w


COEF_SCHEMA = "target int, intercept double, coef array<double>"


def solve(spark: SparkSession, G: np.ndarray, C: np.ndarray, intercept_base: np.ndarray,
          mx: np.ndarray, lam: float) -> DataFrame:
    """Coordinate descent for every target column of ``C`` (d x t).

    ``intercept = intercept_base[t] - mx @ w``.  Targets are a ``spark.range``
    split into contiguous slices over tasks; G and C travel by broadcast.
    """
    ship_package(spark)
    t = C.shape[1]
    bc = spark.sparkContext.broadcast((G, C, intercept_base, mx))
    n_tasks = max(1, min(t, spark.sparkContext.defaultParallelism))

    def run(it):
        Gm, Cm, base, mxv = bc.value
        for pdf in it:
            out = []
            for k in pdf["id"].tolist():
                w = coordinate_descent(Gm, Cm[:, k], lam)
                out.append((int(k), float(base[k] - mxv @ w), w.tolist()))
            yield pd.DataFrame(out, columns=["target", "intercept", "coef"])

    return spark.range(0, t, 1, n_tasks).mapInPandas(run, COEF_SCHEMA)


def fit_lasso(spark: SparkSession, train: DataFrame, d: int, t: int, alpha: float = 1.0,
              x: str = "x", y: str = "y") -> DataFrame:
    """``model_coef(target int, intercept double, coef array<double>)`` on x as given (M4)."""
    if max(d, t) > MAX_WIDTH:
        from aerogrid.plans import wide_lasso
        fit = wide_lasso.fit_wide(spark, train, d, t, alpha, x, y, scaled=False, width=MAX_WIDTH)
        return wide_lasso.dense_coef(spark, fit, d)
    st = moments(train, d, t, x, y)
    return solve(spark, st["mxx"], st["mxy"], st["my"], st["mx"], alpha * st["n"])


def fit_scaled_lasso(spark: SparkSession, train: DataFrame, d: int, t: int, alpha: float = 1.0,
                     x: str = "x", y: str = "y") -> tuple[list[float], list[float], DataFrame]:
    """Scaler (A13) and Lasso on the standardised x (M3 + M4) from one pass.

    Standardising is a diagonal change of basis of the centred moments:
    G = D^-1 Mxx D^-1, C = D^-1 Mxy with D = diag(std); the scaled features
    have mean 0, so the intercept is the target mean.  Wider models go to
    ``wide_lasso``, which builds no Gram over all features.
    """
    if max(d, t) > MAX_WIDTH:
        from aerogrid.plans import wide_lasso
        fit = wide_lasso.fit_wide(spark, train, d, t, alpha, x, y, width=MAX_WIDTH)
        return fit.mean.tolist(), fit.std.tolist(), wide_lasso.dense_coef(spark, fit, d)
    st = moments(train, d, t, x, y)
    mean, std = scaler_from_moments(st)
    G = st["mxx"] / np.outer(std, std)
    C = st["mxy"] / std[:, None]
    coef = solve(spark, G, C, st["my"], np.zeros(d), alpha * st["n"])
    return mean.tolist(), std.tolist(), coef


def coef_arrays(coef: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Coefficient matrix (t x d) and intercepts, bounded by the model size."""
    pdf = coef.toPandas().sort_values("target")
    W = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf["coef"]])
    return W, pdf["intercept"].to_numpy(dtype=np.float64)


def predict(spark: SparkSession, samples: DataFrame, W: np.ndarray, b: np.ndarray, x: str = "x",
            out: str = "yhat", mean=None, std=None) -> DataFrame:
    """yhat = X W' + b per Arrow batch with NumPy (M5); model shipped by broadcast.

    With ``mean`` / ``std`` the features are standardised inside the same
    batch ((x - mean) / std, the scaler of M3), so no separate scale pass.
    """
    ship_package(spark)
    sc = None if mean is None else (np.asarray(mean, dtype=np.float64), np.asarray(std, dtype=np.float64))
    bW = spark.sparkContext.broadcast((W, b, sc))
    schema = StructType([*samples.schema.fields, StructField(out, ArrayType(DoubleType()))])

    def part(it):
        Wm, bv, scv = bW.value
        for pdf in it:
            if len(pdf) == 0:
                yield pdf.assign(**{out: pd.Series([], dtype=object)})
                continue
            X = _stack(pdf[x])
            if scv is not None:
                X = (X - scv[0]) / scv[1]
            Y = X @ Wm.T + bv
            yield pdf.assign(**{out: list(Y)})

    return samples.mapInPandas(part, schema)
