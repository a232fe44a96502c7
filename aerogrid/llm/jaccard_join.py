"""Exact Jaccard join on word shingles by a token-group matrix.

Documents with equal sets fall together first.  Distinct sets are then
partitioned into groups of similar ones, each group stores the union of its
tokens, a set's overlap with every union bounds its overlap with the members,
and only groups whose bound qualifies are opened and compared.

The partition over the cluster comes from a pigeonhole: two sets that link
differ in at most ``(n1 + n2) / 19`` tokens (at 0.9), so if tokens are dealt
into more buckets than that by their hash, at least one bucket is equal in
both.  Sets that share an equal bucket are connected; every link lies inside
one such neighbourhood.  A neighbourhood too large for one task is cut into
parts, and every pair of parts is a unit of its own.  Within a unit the groups
are runs of 32 sets in the order of their least token.

Tokens are 64-bit hashes of shingles, and a set is known by a 64-bit sum over
them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField
from xxhash import xxh64_intdigest

from aerogrid.llm.common import append_computed, bounded_slices, land
from aerogrid.llm.components import connected_components
from aerogrid.session import discard, ship_package

GROUP = 32                 # sets whose tokens share one union
PART_SETS = 2048           # sets of one part of a neighbourhood
PART_TOKENS = 1 << 21
TASK_TOKENS = 1 << 23
CACHE_WORDS = 1 << 20
WEAK = 2                   # tokens of a bucket that says little
M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxh64_intdigest(word, 12)
        if len(word) <= 64:
            self[word] = h
        return h


class Shingles:
    """Sorted distinct shingle hashes of a text; words are runs without
    ``\\x20 \\x09-\\x0D``, only A-Z lower-cased."""

    def __init__(self, size: int):
        self.size, self.hash = size, _WordHash()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.size:
            return np.array([xxh64_intdigest(b" ".join(words), 11)], np.uint64)
        h = np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.size + 1
        total = h[:n].copy()
        for k in range(1, self.size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
        return np.unique(mix(total))


def set_key(tokens: np.ndarray) -> int:
    key = int(np.add.reduce(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)))) + 0x9E3779B97F4A7C15 * len(tokens)
    return (key & M64) - (1 << 64) if key & (1 << 63) else key & M64


class Links:
    """Link when ``den * overlap >= num * union``; what follows for sizes."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def largest_partner(self, n: int) -> int:
        return n * self.den // self.num

    def lonely(self, n: int) -> bool:
        """No set of another content links with one of this size."""
        return n == 0 or (self.largest_partner(n) == n and self.largest_partner(n - 1) < n)

    def least_overlap(self, n):
        return -(-self.num * n // self.den)

    def holds(self, overlap, n1, n2):
        return self.den * overlap >= self.num * (n1 + n2 - overlap)


class Schemes:
    """Size bands and their buckets.  A set of band b links only with sets of
    bands b - 1, b and b + 1, so it signs for schemes b - 1 and b; scheme p
    has one bucket more than sets of bands p and p + 1 can differ in, and
    ``spare`` more: a set with no more weak buckets than that leaves them out,
    since a partner then shares a strong one."""

    def __init__(self, links: Links):
        self.links, self.starts, self.made = links, [1], {}

    def band(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.links.largest_partner(self.starts[-1]) + 1)
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def scheme(self, p: int) -> tuple[int, int, int]:
        if p not in self.made:
            start, after = self.starts[p], self.links.largest_partner(self.starts[p]) + 1
            most = (after - 1) + self.links.largest_partner(after)
            differ = most * (self.links.den - self.links.num) // (self.links.den + self.links.num)
            spare = 2 + (differ + 1) // 20
            buckets = differ + 1 + spare
            self.made[p] = buckets, spare, min(WEAK, start // (4 * buckets))
        return self.made[p]

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if self.links.lonely(n):
            return np.zeros(0, np.uint64)
        band, out, mixed = self.band(n), [], mix(tokens + np.uint64(0xD1B54A32D192ED03))
        for p in (band - 1, band):
            if p < 0:
                continue
            buckets, spare, weak = self.scheme(p)
            at = (tokens % np.uint64(buckets)).astype(np.int64)
            load = np.bincount(at, minlength=buckets)
            sums = np.zeros(buckets, np.uint64)
            np.add.at(sums, at, mixed)
            place = (np.arange(buckets, dtype=np.uint64) << np.uint64(20)) + np.uint64(p)
            strong = load > weak
            if buckets - np.count_nonzero(strong) > spare:
                strong[:] = True
            out.append(mix(sums + mix(place))[strong])
        return np.concatenate(out)


# -- tasks ------------------------------------------------------------------
class _Prints:
    def __init__(self, size: int):
        self.size = size

    def __call__(self):
        self.shingles = Shingles(self.size)
        return self.compute

    def compute(self, texts: pa.Array) -> list[pa.Array]:
        n, keys = [], []
        for text in texts.cast(pa.binary()).to_pylist():
            tokens = self.shingles(text)
            n.append(len(tokens))
            keys.append(set_key(tokens) if len(tokens) else None)
        return [pa.array(n, pa.int64()), pa.array(keys, pa.int64())]


class _Sign:
    """mapInArrow body: text -> (signature, set_key) rows; a set is signed once a task."""

    def __init__(self, size: int, links: Links):
        self.size, self.links = size, links

    def __call__(self, batches):
        shingles, schemes, seen = Shingles(self.size), Schemes(self.links), set()
        for batch in batches:
            for part in bounded_slices(batch, 0):
                signs, keys = [], []
                for text in part.column(0).cast(pa.binary()).to_pylist():
                    tokens = shingles(text)
                    key = set_key(tokens) if len(tokens) else None
                    if key is None or key in seen:
                        continue
                    if len(seen) >= CACHE_WORDS:
                        seen.clear()
                    seen.add(key)
                    found = schemes.signatures(tokens)
                    signs.append(found)
                    keys.append(np.full(len(found), key, np.int64))
                if signs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signs).view(np.int64)), pa.array(np.concatenate(keys))],
                                                     names=["signature", "set_key"])


def _stars(batches):
    """Rows sorted by signature and key: every other key of a signature with
    its least one.  Holds one batch and the last signature."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        s, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.concatenate([[last is None or s[0] != last[0]], s[1:] != s[:-1]])
        run = np.cumsum(new)
        heads = k[new]
        if not new[0]:
            heads = np.concatenate([[last[1]], heads])
            run = run + 1
        center = heads[run - 1]
        last = (s[-1], center[-1])
        on = center != k
        if on.any():
            pairs = np.unique(np.stack([center[on], k[on]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def open_groups(tokens: list[np.ndarray], part: np.ndarray, links: Links) -> list[tuple[int, int]]:
    """Links that connect ``tokens`` as all their links do, by a token-group
    matrix.  Sets of different ``part`` are compared, or all if there is one.

    The matrix is kept by groups: the sorted union of the tokens of each.  A
    set's overlap with every union comes from one pass over them; a group is
    opened where that reaches the least overlap any member could need, and
    some member is not connected with the set yet."""
    n_sets, both = len(tokens), len(set(part.tolist())) > 1
    size = np.array([len(t) for t in tokens], np.int64)
    owner = np.repeat(np.arange(n_sets), size)
    _, column, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    shared = count[column] > 1                        # a token of one set alone is in no overlap
    number = np.cumsum(count > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    starts = np.searchsorted(owner, np.arange(n_sets + 1))
    rows = [column[starts[i]:starts[i + 1]] for i in range(n_sets)]
    first = np.array([t[0] for t in tokens])
    order = np.lexsort((size, first, part))
    groups = [order[at:at + GROUP] for at in range(0, n_sets, GROUP)]
    unions = [np.unique(np.concatenate([rows[i] for i in g])) for g in groups]
    least = np.array([size[g].min() for g in groups])
    place = np.empty(n_sets, np.int64)
    place[order] = np.arange(n_sets)
    matrix, ends = np.concatenate(unions), np.cumsum([len(u) for u in unions])
    held = [(np.concatenate([rows[i] for i in g]), np.cumsum([len(rows[i]) for i in g])) for g in groups]
    marks = np.zeros(int((count > 1).sum()) + 1, np.int64)
    label, found = np.arange(n_sets), []
    for q in order.tolist():
        marks[rows[q]] = 1
        sums = np.cumsum(marks[matrix])
        overlap = np.diff(np.concatenate([[0], np.where(ends > 0, sums[ends - 1], 0) if len(sums) else ends]))
        bound = links.least_overlap(np.maximum(size[q], least))
        for g in np.flatnonzero(overlap >= bound).tolist():
            members = groups[g]
            if place[members[-1]] <= place[q]:        # those pairs have been seen from the other side
                continue
            on = (label[members] != label[q]) & (place[members] > place[q])
            if both:
                on &= part[members] != part[q]
            if not on.any():
                continue
            flat, to = held[g]
            sums = np.cumsum(np.concatenate([[0], marks[flat]]))
            same = np.diff(np.concatenate([[0], sums[to]]))
            for i in members[on & links.holds(same, size[members], size[q])].tolist():
                if label[i] != label[q]:
                    found.append((q, i))
                    label[label == label[i]] = label[q]
        marks[rows[q]] = 0
    return found


class _Open:
    """mapInArrow body over rows sorted by unit: one unit is held at a time."""

    def __init__(self, size: int, links: Links):
        self.size, self.links = size, links

    def __call__(self, batches):
        self.shingles, unit, held = Shingles(self.size), None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if (r["root"], r["i"], r["j"]) != unit:
                    yield from self.flush(held)
                    unit, held = (r["root"], r["i"], r["j"]), {}
                if r["set_key"] not in held:
                    held[r["set_key"]] = (self.shingles(r["text"].encode()), r["part"])
        yield from self.flush(held)

    def flush(self, held):
        keys = list(held)
        if len(keys) > 1:
            pairs = open_groups([held[k][0] for k in keys], np.array([held[k][1] for k in keys]), self.links)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in pairs], pa.int64()),
                                                  pa.array([keys[b] for _, b in pairs], pa.int64())], names=["a", "b"])


# -- the operator -----------------------------------------------------------
def neighbourhoods(slim: DataFrame, shingle_words: int, links: Links) -> DataFrame:
    """``(set_key, root)`` of the sets that share an equal bucket with another one."""
    signed = slim.select("text").mapInArrow(_Sign(shingle_words, links), "signature long, set_key long")
    stars = (signed.repartition("signature").sortWithinPartitions("signature", "set_key").mapInArrow(_stars, "a long, b long"))
    return connected_components(stars, "a", "b").select(F.col("node").alias("set_key"), "root")


def links_within(slim: DataFrame, sets: DataFrame, near: DataFrame, shingle_words: int, links: Links) -> DataFrame:
    """``(a, b)``: set keys whose links connect what all links connect."""
    spark = slim.sparkSession
    chosen = sets.join(near, "set_key").select("set_key", "root", "n", F.col("first.id").alias("doc"), F.col("first.text_key").alias("key"))
    sizes = chosen.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    parts = F.greatest(F.ceil(F.col("sets") / PART_SETS), F.ceil(F.col("tokens") / PART_TOKENS)).cast("int")
    total = sizes.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    split = sizes.select("root", parts.alias("parts")).where("parts > 1")
    texts = slim.join(chosen, slim["id"].eqNullSafe(F.col("doc")) & (slim["text_key"] == F.col("key"))).select("set_key", "root", "text")
    placed = (texts.join(split, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
              .withColumn("part", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int")))
    units = placed.select("root", "set_key", "text", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    units = units.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "set_key", "text")
    tasks = max(3 * spark.sparkContext.defaultParallelism, -(-total // TASK_TOKENS))
    return (units.repartition(tasks, "root", "i", "j").sortWithinPartitions("root", "i", "j")
            .mapInArrow(_Open(shingle_words, links), "a long, b long"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                      num: int = 90, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    Two documents link when ``den * intersection >= num * union`` of their
    distinct shingles; ``component_id`` is the smallest id reachable over
    links.  A text with fewer words than a shingle is one shingle; null and
    wordless texts have none, link with nothing and are their own component.
    Null ids are ignored by the minimum; a component without any id has a null
    ``component_id``.  Repeated rows give repeated results, an empty table
    none; other columns are not read.
    """
    ship_package(docs.sparkSession)
    links = Links(num, den)
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    prints = land(append_computed(slim, "text", _Prints(shingle_words), [StructField("n", LongType()), StructField("set_key", LongType())],
                                  keep=["id", "text_key"]), "jaccard-prints")
    member = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")
    sets = land(prints.where("set_key is not null").groupBy("set_key", "n").agg(F.min(member).alias("first")), "jaccard-sets")
    near = land(neighbourhoods(slim, shingle_words, links), "jaccard-near")
    found = land(links_within(slim, sets, near, shingle_words, links), "jaccard-links")
    nodes = land(connected_components(found, "a", "b"), "jaccard-nodes")
    discard(near, found)
    ids = sets.select("set_key", F.col("first.id").alias("first_id"))
    by_root = nodes.join(ids, nodes["node"] == ids["set_key"]).groupBy("root").agg(F.min("first_id").alias("root_id"))
    linked = nodes.join(by_root, "root").select(F.col("node").alias("set_key"), "root_id", F.lit(True).alias("linked"))
    groups = land(ids.join(linked, "set_key", "left").select(
        "set_key", F.when(F.col("linked"), F.col("root_id")).otherwise(F.col("first_id")).alias("component"), F.lit(True).alias("known")),
        "jaccard-groups")
    return prints.join(groups, "set_key", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("known"), F.col("component")).otherwise(F.col("id")).alias("component_id"))
