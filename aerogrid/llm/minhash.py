"""Document fingerprints by one-permutation MinHash.

Every shingle of five words is hashed once.  The top bits of the hash choose
a bin, which keeps its smallest value.  Empty bins borrow from bins chosen by
a random walk that depends on the bin alone (optimal densification,
Shrivastava 2017).  Each bin stores its low-order bits only; the share of
chance agreement, ``2**-bits``, is corrected when two fingerprints are
compared.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType
from xxhash import xxh64_intdigest

from aerogrid.llm.common import bounded_slices
from aerogrid.session import ship_package

SHINGLE_WORDS = 5
BINS = 256
BITS = 4
SEED = 42
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))   # fixed values: the 64-bit finaliser of MurmurHash3
_WALK = 64
RANGES_PER_TASK = 3      # several to a task, so that tasks even out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(33))


def donors(bins: int = BINS) -> np.ndarray:
    """For each bin the walk of bins it asks when it is empty, then all others
    in turn, so that any filled bin is found."""
    walk = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(_WALK, dtype=np.uint64)
    rest = (np.arange(bins)[:, None] + np.arange(1, bins)) % bins
    return np.concatenate([(mix(walk + np.uint64(1)) % np.uint64(bins)).astype(np.int64), rest], axis=1)


class MinHash:
    def __init__(self, bins: int = BINS, bits: int = BITS, shingle_words: int = SHINGLE_WORDS):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two and bits 1, 2, 4 or 8")
        self.bins, self.bits, self.shingle_words = bins, bits, shingle_words
        self.donors = donors(bins)

    def shingles(self, text: str) -> np.ndarray:
        """Hashes of all runs of five words (all words of a shorter text)."""
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter((xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
        k = min(self.shingle_words, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = mix(out ^ h[i:len(h) - k + 1 + i]) + np.uint64(i + 1)
        return mix(out)

    def sketch(self, text: str) -> np.ndarray:
        """Low-order bits of each bin; all zero for a text without words."""
        h = self.shingles(text)
        if not len(h):
            return np.zeros(self.bins, np.uint8)
        h = np.sort(h)
        width = np.uint64(64 - int(np.log2(self.bins)))
        which = (h >> width).astype(np.int64)
        first = np.searchsorted(which, np.arange(self.bins))
        filled = np.zeros(self.bins, bool)
        filled[which] = True
        value = np.where(filled, h[np.minimum(first, len(h) - 1)], np.uint64(0))
        empty = np.flatnonzero(~filled)
        if len(empty):
            choice = self.donors[empty]
            step = filled[choice].argmax(axis=1)
            # a donor's value counts with the step at which it was reached
            value[empty] = mix(value[choice[np.arange(len(empty)), step]] + step.astype(np.uint64))
        return (mix(value) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def pack(self, sketch: np.ndarray) -> str:
        """Packed bits in hexadecimal."""
        per = 8 // self.bits
        parts = sketch.reshape(-1, per) << (np.arange(per, dtype=np.uint8) * self.bits)
        return np.bitwise_or.reduce(parts, axis=1).astype(np.uint8).tobytes().hex()

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        """Estimated Jaccard similarity of two sketches: the share of equal
        bins, less what equal low bits give by chance; 0 to 1."""
        chance = 2.0 ** -self.bits
        return min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1 - chance)))


def edited(text: str, following: str) -> str:
    """The last ``n // 2`` code points replaced by the first as many of the next text."""
    n = len(text)
    return text[:n - n // 2] + following[:n // 2]


class _Walk:
    """mapInArrow body over rows sorted by (part, id): each row meets the one
    behind it.  A row marked as a halo only stands behind the last of a part."""

    def __init__(self, settings: tuple[int, int, int], names: list[str]):
        self.settings, self.names = settings, names

    def __call__(self, batches):
        hasher, before = MinHash(*self.settings), None
        for batch in batches:
            for part in bounded_slices(batch, 1):
                rows = []
                for row in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    doc_id, text, part_no, halo = row[0], row[1] or "", row[2], row[3]
                    sketch = hasher.sketch(text)
                    if before is not None and before[2] == part_no:
                        rows.append(self.result(hasher, before, text, sketch))
                    before = None if halo else (doc_id, text, part_no, sketch)
                if rows:
                    yield self.batch(rows, batch.schema.field(0).type)

    @staticmethod
    def result(hasher: MinHash, row: tuple, following: str, next_sketch: np.ndarray) -> tuple:
        doc_id, text, _, sketch = row
        changed = edited(text, following)
        other = hasher.sketch(changed)
        return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), hasher.pack(sketch), hasher.pack(other),
                hasher.likeness(sketch, other), hasher.likeness(sketch, next_sketch))

    def batch(self, rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=self.names)


def quantiles(rows: DataFrame, col: str, n: int) -> list:
    """Up to ``n - 1`` distinct values that cut the rows into ranges of like size."""
    if n < 2:
        return []
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    return sorted(set(rows.agg(F.percentile_approx(col, shares, 20 * n).alias("cuts")).first()["cuts"] or []))


def range_of(value: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` lie below the value, in two strides of their square root."""
    if not cuts:
        return F.lit(0)
    stride = math.isqrt(len(cuts) - 1) + 1
    below = lambda some: F.aggregate(some, F.lit(0), lambda n, cut: n + (cut < value).cast("int"))
    coarse = below(F.array(*map(F.lit, cuts[stride - 1::stride]))) * stride if len(cuts) >= stride else F.lit(0)
    return coarse + below(F.slice(F.array(*map(F.lit, cuts)), coarse + 1, stride))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS,
                      shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next)``.

    The next document is that with the next id in ascending order (rows of
    one id in the order of their text hash, null ids first), after the last
    the first.  Ids are numbers.  Null texts count as empty; texts without words have an all-zero
    fingerprint.  A single row is its own next; an empty table gives none.

    Ids are cut into ranges by their quantiles; each range gets a copy of the
    first row behind it, so whole texts are shuffled once and no task sees
    more than its range.
    """
    spark = docs.sparkSession
    ship_package(spark)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = quantiles(slim, "doc_id", RANGES_PER_TASK * n_tasks)
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    placed = slim.select("doc_id", "text", F.coalesce(range_of(F.col("doc_id"), cuts), F.lit(0)).alias("part"),
                         F.xxhash64("text").alias("tie"))          # null ids stand first
    firsts = sorted((r["part"], r["first"]["doc_id"]) for r in placed.groupBy("part").agg(F.min(order).alias("first")).collect())
    halo = spark.createDataFrame([(part, first, firsts[i - 1][0]) for i, (part, first) in enumerate(firsts)],
                                 StructType([StructField("first_part", IntegerType()), StructField("first_id", slim.schema["doc_id"].dataType),
                                             StructField("behind", IntegerType())]))
    target = F.struct("part", F.lit(False).alias("halo"))
    copies = F.when(F.col("behind").isNull(), F.array(target)).otherwise(
        F.array(target, F.struct(F.col("behind").alias("part"), F.lit(True).alias("halo"))))
    spread = (placed.join(F.broadcast(halo),                        # a row per range
                          (F.col("part") == F.col("first_part")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
              .select("doc_id", "text", "tie", F.explode(copies).alias("to"))
              .select("doc_id", "text", F.col("to.part").alias("part"), F.col("to.halo").alias("halo"), "tie")
              .repartition(n_tasks, "part").sortWithinPartitions("part", "halo", F.col("doc_id").asc_nulls_first(), "tie"))
    id_field = StructField("doc_id", slim.schema["doc_id"].dataType)
    schema = StructType([id_field, StructField("n_chars", LongType()), StructField("edited_sha256", StringType()),
                         StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()),
                         StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())])
    return spread.mapInArrow(_Walk((bins, bits, shingle_words), schema.names), schema)
