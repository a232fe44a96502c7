"""Quality classifier by positive-unlabelled learning: the non-negative
unbiased risk (Kiryo et al., 2017) with trusted positives, unlabelled web text
and an estimated class prior.

The score is logistic in the features, so that the unbiased risk is convex (du
Plessis et al., 2015) and Newton's method needs only sums over rows: every
positive and every unlabelled text takes part, each step is one Spark job over
the landed features, and the driver gets a matrix as wide as the features.
The prior comes from positives and unlabelled texts alone (best bin
estimation, Garg et al., 2021).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField

from aerogrid.llm.common import append_computed, filter_texts, land
from aerogrid.session import discard, ship_package

RIDGE = 0.01             # weight of half the squared coefficients in the risk
STEPS = 12               # evaluations of the risk by one fit, halved steps included
SMALL = 1e-6             # a fit ends when a step promises less
BINS = 1024              # score classes from which the prior is read
FAILURE = 0.1            # chance at which the bound behind the prior's bin fails
ROWS = 4096              # rows of features held at once inside a task

#: Classes of UTF-8 bytes: space, line end, lower, upper, digit, beyond ASCII, then marks by kind.
_KINDS = [b" \t", b"\r\n\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(128, 256)),
          b".", b",;:", b"!", b"?", b"'\"`", b"-_/\\", b"()[]{}<>", b"|", b"#$%&*+=@^~"]
N_KINDS = len(_KINDS) + 1
KIND = np.full(256, N_KINDS - 1, np.uint8)
for _i, _bytes in enumerate(_KINDS):
    KIND[list(_bytes)] = _i
N_STATS = 12
N_FEATURES = N_KINDS * N_KINDS + N_STATS
PIECE = 1 << 20


def features(text: bytes | None) -> np.ndarray:
    """Frequencies of adjacent byte classes and a few measures of the whole text."""
    text = text or b""
    pairs = np.zeros(N_KINDS * N_KINDS)
    for at in range(0, max(len(text) - 1, 0), PIECE):       # bounded temporaries on very long texts
        kinds = KIND[np.frombuffer(text, np.uint8, min(PIECE + 1, len(text) - at), at)].astype(np.int64)
        pairs += np.bincount(kinds[:-1] * N_KINDS + kinds[1:], minlength=N_KINDS * N_KINDS)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    lower = text.lower().split()
    distinct, seen = set(lower), {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    n, m = max(len(words), 1), max(len(lines), 1)
    top = 0
    if lower:
        counts: dict[bytes, int] = {}
        for w in lower:
            counts[w] = counts.get(w, 0) + 1
        top = max(counts.values())
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    stats = [np.log1p(len(text)), np.log1p(len(words)), sizes.mean(), sizes.std(), len(distinct) / n, top / n,
             np.log1p(len(lines)), len(words) / m / 50, sum(k for k in seen.values() if k > 1) / m, max(seen.values(), default=0) / m,
             sum(w.isupper() for w in words) / n, sum(w.isalpha() or max(w) > 127 for w in words) / n]
    return np.concatenate([np.sqrt(pairs / max(pairs.sum(), 1)), stats]).astype(np.float32)


@dataclass
class Model:
    """A standardised input, one weight per feature, a constant and the class prior."""
    mean: np.ndarray
    scale: np.ndarray
    theta: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that a text is good."""
        return _sigmoid(self.standard(x) @ self.theta)

    def standard(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([z, np.ones(len(z))])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


@dataclass
class Sums:
    """What the risk, its gradient and its curvature need of the rows, at one
    ``theta``; sums over parts of the rows add up."""
    curvature: np.ndarray    # unlabelled: x x' weighted by p (1 - p)
    pull: np.ndarray         # unlabelled: x weighted by p
    good: np.ndarray         # positives: x
    totals: np.ndarray       # rows and summed loss as bad of the unlabelled; rows, loss as bad, loss as good of the positives

    @staticmethod
    def of(x: np.ndarray, good: np.ndarray, theta: np.ndarray) -> Sums:
        """Every row is unlabelled; those marked ``good`` are positives as well."""
        z = x @ theta
        p, bad = _sigmoid(z), np.logaddexp(0, z)
        return Sums((x * (p * (1 - p))[:, None]).T @ x, x.T @ p, x[good].sum(axis=0),
                    np.array([len(x), bad.sum(), good.sum(), bad[good].sum(), np.logaddexp(0, -z[good]).sum()]))

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.curvature + other.curvature, self.pull + other.pull, self.good + other.good, self.totals + other.totals)

    def parts(self, prior: float) -> tuple[float, float]:
        """``prior * R+(p)`` and ``R-(u) - prior * R-(p)``."""
        n_u, bad_u, n_p, bad_p, good_p = self.totals
        return prior * good_p / n_p, bad_u / n_u - prior * bad_p / n_p


def minimise(evaluate: Callable[[np.ndarray], Sums], theta: np.ndarray, prior: float) -> np.ndarray:
    """Minimise ``prior * R+(p) + max(0, R-(u) - prior * R-(p))`` plus the ridge
    by Newton's method.  A step is halved until the risk falls and the second
    term is not negative: below zero the bound is flat there, and further
    descent would only fit the positives."""
    def risk(sums, at):
        plus, minus = sums.parts(prior)
        return plus + max(0.0, minus) + RIDGE / 2 * at @ at, minus

    sums, left = evaluate(theta), STEPS - 1
    now, _ = risk(sums, theta)
    while left:
        n_u, _, n_p, _, _ = sums.totals
        gradient = sums.pull / n_u - prior * sums.good / n_p + RIDGE * theta
        step = np.linalg.solve(sums.curvature / n_u + RIDGE * np.eye(len(theta)), -gradient)
        if -gradient @ step < SMALL:
            break
        size, found = 1.0, False
        while left and not found:
            left -= 1
            tried = evaluate(theta + size * step)
            value, minus = risk(tried, theta + size * step)
            found = value < now and minus >= 0
            if found:
                theta, sums, now = theta + size * step, tried, value
            size /= 2
    return theta


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from counts of positives and unlabelled texts by rising
    score class: the share of unlabelled texts over that of positives above a
    score bounds the prior; the score is the one whose bound with its error is
    the smallest."""
    n_p, n_u = int(positive.sum()), int(unlabelled.sum())
    if not n_p or not n_u:
        return 0.5
    above_p, above_u = np.cumsum(positive[::-1]) / n_p, np.cumsum(unlabelled[::-1]) / n_u
    error = np.sqrt(np.log(4 / FAILURE) / 2 / n_p) + np.sqrt(np.log(4 / FAILURE) / 2 / n_u)
    used = above_p > 0
    best = np.argmin((above_u[used] + error) / above_p[used])
    return float(np.clip(above_u[used][best] / above_p[used][best], 0.01, 0.99))


def _bins(score: np.ndarray) -> np.ndarray:
    return np.minimum((score * BINS).astype(np.int64), BINS - 1)


class _Features:
    def __call__(self):
        return self.compute

    def compute(self, texts: pa.Array) -> list[pa.Array]:
        rows = (np.minimum(features(t), 6e4).astype(np.float16) for t in texts.cast(pa.binary()).to_pylist())
        return [pa.array([x.tobytes() for x in rows], pa.binary())]


def _blocks(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(x, good)`` of the landed features, a bounded number of rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = np.frombuffer(b"".join(part.column(1).to_pylist()), np.float16).reshape(-1, N_FEATURES)
            yield x.astype(np.float64), part.column(0).to_numpy(zero_copy_only=False).astype(bool)


class _Partial:
    """mapInArrow body: numbered vectors of one task, summed over its rows."""

    def __init__(self, vectors: Callable):
        self.vectors = vectors

    def __call__(self, batches):
        total = None
        for x, good in _blocks(batches):
            new = self.vectors(x, good)
            total = new if total is None else [a + b for a, b in zip(total, new, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([v.tobytes() for v in total], pa.binary())],
                                             names=["i", "v"])


def _add_up(batches):
    """mapInArrow body: the sum of the vectors of each number."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[i] = total.get(i, 0) + np.frombuffer(v, np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                     names=["i", "v"])


def _sum_vectors(rows: DataFrame, vectors: Callable) -> list[np.ndarray]:
    """Sums over all rows: per task, then per number, so that the driver gets
    each vector once, however many tasks there are."""
    schema = "i int, v binary"
    table = rows.mapInArrow(_Partial(vectors), schema).repartition("i").mapInArrow(_add_up, schema).toArrow()
    found = dict(zip(table["i"].to_pylist(), table["v"].to_pylist(), strict=True))
    return [np.frombuffer(found[i], np.float64) for i in range(len(found))]


def _moments(x: np.ndarray, good: np.ndarray) -> list[np.ndarray]:
    return [x.sum(axis=0), (x * x).sum(axis=0), np.array([len(x), good.sum()], np.float64)]


class _At:
    """The vectors of ``Sums`` or of the score classes, at one model."""

    def __init__(self, model: Model, classes: bool = False):
        self.model, self.classes = model, classes

    def __call__(self, x: np.ndarray, good: np.ndarray) -> list[np.ndarray]:
        if self.classes:
            found = _bins(self.model.score(x))
            return [np.bincount(found[good], minlength=BINS).astype(np.float64), np.bincount(found, minlength=BINS).astype(np.float64)]
        s = Sums.of(self.model.standard(x), good, self.model.theta)
        return [*s.curvature, s.pull, s.good, s.totals]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_id_col: str = "doc_id", quality_col: str = "quality") -> Model:
    """Fit on every row of ``docs`` as an unlabelled text, and on every one
    whose label is 1 as a trusted positive; other labels are not read.

    Features are made once, map-side, and land without the texts.  A null id
    matches no label, a repeated label counts once, repeated rows of ``docs``
    each count.  Null texts are empty ones.  Without rows or positives there
    is nothing to learn: every text then scores 0.5.
    """
    spark = docs.sparkSession
    ship_package(spark)
    model = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), 0.5)
    good = labels.where(F.col(quality_col) == 1).select(F.col(label_id_col).alias("good_id")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = append_computed(texts, "text", _Features(), [StructField("x", BinaryType())], keep=["id"])
    rows = land(made.join(good, F.col("id") == F.col("good_id"), "left").select(F.col("good_id").isNotNull().alias("good"), "x"),
                "quality-features")
    try:
        found = _sum_vectors(rows, _moments)
        if not found or not found[2].all():
            return model
        n = found[2][0]
        model.mean = found[0] / n
        model.scale = np.maximum(np.sqrt(np.maximum(found[1] / n - model.mean ** 2, 0)), 1e-3)

        def evaluate(theta: np.ndarray) -> Sums:
            v = _sum_vectors(rows, _At(replace(model, theta=theta)))
            return Sums(np.array(v[:-3]), *v[-3:])

        # the order of the scores does not hang on the prior, so one half of either class will do to find it
        model.theta = minimise(evaluate, model.theta, 0.5)
        model.prior = best_bin_prior(*_sum_vectors(rows, _At(model, classes=True)))
        model.theta = minimise(evaluate, model.theta, model.prior)
        return model
    finally:
        discard(rows)


class _Score:
    def __init__(self, model, threshold: float | None = None):
        self.model, self.threshold = model, threshold

    def __call__(self):
        return self.columns if self.threshold is None else self.keep

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows = [features(t) for t in texts.cast(pa.binary()).to_pylist()]
        return self.model.value.score(np.array(rows, np.float64).reshape(-1, N_FEATURES))

    def columns(self, texts: pa.Array) -> list[pa.Array]:
        score = self.scores(texts)
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    def keep(self, texts: pa.Array) -> pa.Array:
        return pa.array(self.scores(texts) >= self.threshold)


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``score`` (0 to 1) and ``predicted``
    (1 from 0.5 on).  Null texts score as empty; rows map one to one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append_computed(docs, text_col, _Score(shared), [StructField("score", DoubleType()), StructField("predicted", IntegerType())],
                           keep=keep)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns kept, that score ``threshold`` or more.
    Null texts score as empty ones; repeated rows stay or go together."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_texts(docs, text_col, _Score(shared, threshold))
