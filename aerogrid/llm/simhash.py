"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``max_bits`` have a common point within half of it
from either.  Every distinct fingerprint emits all variants within that
half-radius; fingerprints that meet on a variant are candidates.  A variant
gathers at most as many distinct fingerprints as there are variants of one
(65 for two bits), so no bucket grows with the data: copies fall together
before, when fingerprints are made distinct.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField
from xxhash import xxh64_intdigest

from aerogrid.llm.common import append_computed, free_name, land
from aerogrid.llm.components import connected_components

SEED = 42
BLOCK = 1 << 16          # shingles whose bits are summed at once


def simhash(text: bytes | None, shingle_words: int = 3) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half of the
    shingles' XXH64 hashes.  A null or wordless text gives 0."""
    words = (text or b"").lower().split()     # bytes: A-Z and \x20 \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:len(words) - shingle_words + 1]
    ends = ends[shingle_words - 1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        spans = zip(starts[at:at + BLOCK].tolist(), ends[at:at + BLOCK].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


class _Fingerprints:
    def __init__(self, shingle_words: int):
        self.shingle_words = shingle_words

    def __call__(self):
        return self.compute

    def compute(self, texts: pa.Array) -> list[pa.Array]:
        found = [simhash(t, self.shingle_words) for t in texts.cast(pa.binary()).to_pylist()]
        return [pa.array(np.array(found, np.uint64).view(np.int64))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = 3) -> DataFrame:
    """``(id, text_key, fingerprint)``: the 64 bits as a signed long, and a
    hash of the text that tells rows of one id apart."""
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"),
                       F.col(text_col).alias("text"))
    return append_computed(slim, "text", _Fingerprints(shingle_words), [StructField("fingerprint", LongType())],
                           keep=["id", "text_key"])


def ball_masks(bits: int) -> list[int]:
    """XOR masks of all points within ``bits`` of a fingerprint, as signed longs."""
    masks = [sum(1 << i for i in c) for k in range(bits + 1) for c in combinations(range(64), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def ball_links(points: DataFrame, max_bits: int) -> DataFrame:
    """Verified links ``(a, b)`` between distinct fingerprints (column
    ``fingerprint``) that connect exactly those within ``max_bits``.

    In a bucket, the smallest fingerprint within the inner half-radius is
    linked to every other one: each of them lies within ``max_bits`` of it,
    and any pair that meets here is joined through it, so no pair is lost
    though a bucket emits a star and not its pairs.
    """
    inner, outer = max_bits // 2, max_bits - max_bits // 2
    n_inner = len(ball_masks(inner))
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(outer)])
    variants = points.where("fingerprint is not null").select("fingerprint", F.posexplode(masks).alias("k", "mask")).select(
        "fingerprint", (F.col("k") < n_inner).alias("is_inner"),
        F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"))
    center = F.min(F.when(F.col("is_inner"), F.col("fingerprint"))).over(Window.partitionBy("variant"))
    return (variants.select("fingerprint", center.alias("center"))
            .where("center <> fingerprint").distinct()
            .where(F.bit_count(F.col("center").bitwiseXOR(F.col("fingerprint"))) <= max_bits)
            .select(F.col("center").alias("a"), F.col("fingerprint").alias("b")))


def _group_map(prints: DataFrame, max_bits: int) -> DataFrame:
    """``(fingerprint, first)``: for every fingerprint the smallest ``member``
    (any ordered column of ``prints``, null if all are) of its component."""
    firsts = land(prints.groupBy("fingerprint").agg(F.min("member").alias("first")), "simhash-distinct")
    nodes = land(connected_components(ball_links(firsts, max_bits), "a", "b"), "simhash-nodes")
    by_root = land(nodes.join(firsts, nodes["node"] == firsts["fingerprint"])
                   .groupBy("root").agg(F.min("first").alias("root_first")), "simhash-roots")
    linked = nodes.join(by_root, "root").select(F.col("node").alias("fingerprint"), "root_first",
                                                F.lit(True).alias("linked"))
    return land(firsts.join(linked, "fingerprint", "left").select(
        "fingerprint", F.when(F.col("linked"), F.col("root_first")).otherwise(F.col("first")).alias("first")),
        "simhash-groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, fingerprint, component_id)`` with
    the fingerprint as a signed long and the smallest id reachable over links.

    Null and wordless texts have fingerprint 0 and link like any other.  Null
    ids are ignored by the minimum; a component without any id has a null
    ``component_id``.  Repeated rows give repeated results; an empty table
    gives none; other columns of ``docs`` are not read.
    """
    prints = land(fingerprints(docs, id_col, text_col, shingle_words).select("id", "fingerprint"), "simhash-prints")
    groups = _group_map(prints.select("fingerprint", F.col("id").alias("member")), max_bits)
    return prints.join(groups, "fingerprint").select(
        F.col("id").alias("doc_id"), "fingerprint", F.col("first").alias("component_id"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null
    ids last), and of its texts the one with the smallest hash.  Repeated rows
    fall to one."""
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")
    prints = land(fingerprints(docs, id_col, text_col, shingle_words).select("fingerprint", key.alias("member")),
                  "simhash-prints")
    kept = _group_map(prints, max_bits).select(F.col("first.id").alias("kept_id"),
                                               F.col("first.text_key").alias("kept_key")).distinct()
    name = free_name(docs, "text_key")
    keyed = docs.withColumn(name, F.xxhash64(F.col(text_col)))
    return (keyed.join(kept, keyed[id_col].eqNullSafe(kept["kept_id"]) & (keyed[name] == kept["kept_key"]), "left_semi")
            .dropDuplicates([id_col, name]).select(docs.columns))
