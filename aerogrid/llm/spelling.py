"""Spelling variant grouping by search schemes over a bidirectional FM-index.

Two words are near if one insertion, deletion or replacement turns one into
the other.  Then either half of a word is found unchanged at the matching end
of the other.  So every word is sent to the halves that it may share (a
prefix and a suffix for each length of partner, six routes in all), routes
are gathered into blocks of bounded size, and each block is a delimited
vocabulary with an FM-index of its own in both directions.  Every word then
searches its two blocks: one half matched exactly, delimiter included, then
the other half extended in the other direction with one error.  Forward and
reverse suffix-rank intervals move together, so the last interval of a hit is
the rank of its word.

A route with more texts than a block holds is split by text, and its
searching words visit every part: memory stays bounded and no pair is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerogrid.llm.common import land
from aerogrid.session import discard, ship_package

LEAST_LENGTH = 5
BLOCK_CHARS = 1 << 17      # text of one index, delimiters included
ROUTE_WORDS = 1 << 14      # texts of one part of a route
PATTERNS = 4096            # words searched at once
STRIDE = 8                 # rank table: one row in so many positions
FLUSH = 300_000            # distinct words a task holds before it emits their counts
LETTERS = re.compile("[a-zÀ-ÿ]+")


# -- words ------------------------------------------------------------------
class _Count:
    """mapInArrow body: (id, text) -> (word, n), summed within the task."""

    def __init__(self, every: int | None):
        self.every = every

    def __call__(self, batches):
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(LETTERS.findall(text.lower().decode())).items():
                    if self.every and (h := zlib.crc32(word.encode(), prefix)) % self.every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) > FLUSH:
                    yield self.batch(held)
                    held = Counter()
        if held:
            yield self.batch(held)

    @staticmethod
    def batch(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_n: int = 3, damage_every: int | None = None) -> DataFrame:
    """``(word, n)``: runs of ASCII letters and U+00C0 to U+00FF of whole texts,
    only A-Z lower-cased, of at least five code points and ``least_n``
    occurrences overall.

    With ``damage_every`` a run of a document loses one code point where that
    number divides the crc32 of ``<id>:<run>`` (a null id counts as empty).
    Null and empty texts have no words; an empty table gives none.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counted = slim.mapInArrow(_Count(damage_every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# -- index ------------------------------------------------------------------
def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffixes of a text of sorted words, a 0 before each and one at the end.

    The delimiters rank by the words after them, the last one first, so that
    every suffix is unique once it reaches one: prefix doubling ends after as
    many rounds as the longest word's length has bits."""
    n = len(codes)
    seps = np.flatnonzero(codes == 0)
    rank = codes.astype(np.int64) + len(seps)
    rank[seps] = np.arange(1, len(seps) + 1)
    rank[n - 1] = 0
    h = 1
    while True:
        key = rank * (rank.max() + 1) + np.roll(rank, -h)
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        rank[order] = new
        if new[-1] == n - 1:
            return order
        h *= 2


class Ranks:
    """How many symbols below ``c`` stand before position ``i`` of a BWT:
    counts at every eighth position, the rest by looking."""

    def __init__(self, codes: np.ndarray, n_symbols: int):
        bwt = np.roll(codes, 1)[suffix_array(codes)]
        n = len(bwt)
        windows = np.full((n // STRIDE + 1) * STRIDE, n_symbols + 3, np.int32)
        windows[:n] = bwt
        self.windows = windows.reshape(-1, STRIDE)
        self.symbols = np.arange(n_symbols + 3, dtype=np.int32)
        counts = np.zeros((len(self.windows) + 1, n_symbols + 3), np.int32)
        for at in range(0, len(self.windows), 1 << 13):
            part = self.windows[at:at + (1 << 13)]
            counts[at + 1:at + 1 + len(part)] = (part[:, :, None] < self.symbols).sum(axis=1)
        self.counts = np.cumsum(counts, axis=0, dtype=np.int32)
        self.before = np.arange(STRIDE)

    def below(self, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        row = i // STRIDE
        seen = (self.windows[row] < c[:, None]) & (self.before < (i % STRIDE)[:, None])
        return self.counts[row, c] + seen.sum(axis=1)

    def below_all(self, i: np.ndarray) -> np.ndarray:
        row = i // STRIDE
        seen = (self.windows[row][:, :, None] < self.symbols) & (self.before < (i % STRIDE)[:, None])[:, :, None]
        return self.counts[row] + seen.sum(axis=1)


LEFT, RIGHT = 0, 1


class Index:
    """FM-index of a delimited vocabulary in both directions.

    A state is an interval of each: ``lo[LEFT]`` in the index of the words,
    ``lo[RIGHT]`` in that of the reversed words, and one size for both."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        alphabet = sorted(set().union(*map(set, self.words)))
        self.code = {ch: i + 1 for i, ch in enumerate(alphabet)}
        n_symbols = len(alphabet)
        self.ranks = [Ranks(self.encode(side), n_symbols) for side in (self.words, sorted(w[::-1] for w in self.words))]
        codes = self.encode(self.words)
        self.n, self.n_symbols = len(codes), n_symbols
        self.first = np.searchsorted(np.sort(codes), np.arange(n_symbols + 2)).astype(np.int64)

    def encode(self, words: list[str]) -> np.ndarray:
        code = {**self.code, "\x00": 0}
        return np.array([code[ch] for ch in "\x00" + "\x00".join(words) + "\x00"], np.int32)

    def extend(self, side: int, lo: list[np.ndarray], size: np.ndarray, c: np.ndarray):
        """The states after symbols ``c`` are put to the left or right end."""
        ranks, here = self.ranks[side], lo[side]
        a, b = ranks.below(here, c), ranks.below(here + size, c)
        a1, b1 = ranks.below(here, c + 1), ranks.below(here + size, c + 1)
        new = [None, None]
        new[side], new[1 - side] = self.first[c] + a1 - a, lo[1 - side] + b - a
        return new, (b1 - a1) - (b - a)

    def extend_all(self, side: int, lo: list[np.ndarray], size: np.ndarray):
        """Every non-empty extension but the delimiter: (state, symbol, lo, size)."""
        ranks, here = self.ranks[side], lo[side]
        a, b = ranks.below_all(here), ranks.below_all(here + size)
        sizes = np.diff(b - a, axis=1)
        sizes[:, 0] = 0
        state, c = np.nonzero(sizes)
        new = [None, None]
        new[side] = self.first[c] + a[state, c + 1] - a[state, c]
        new[1 - side] = lo[1 - side][state] + b[state, c] - a[state, c]
        return state, c, new, sizes[state, c]


def _pick(lo, keep):
    return [lo[0][keep], lo[1][keep]]


def _join(*states):
    return (np.concatenate([s[0] for s in states]), [np.concatenate([s[1][k] for s in states]) for k in (0, 1)],
            np.concatenate([s[2] for s in states]))


def search(index: Index, flat: np.ndarray, start: np.ndarray, length: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """``(pattern, word)`` numbers one error apart, with the error in the half
    that is extended to the ``side``; the other half and its delimiter match.

    ``flat`` holds the patterns' symbols, ``start`` and ``length`` their places."""
    half = length // 2
    if side == RIGHT:       # first half inwards to the delimiter, then outwards
        exact_at, exact_n, exact_step, walk_at, walk_n, walk_step = start + half - 1, half, -1, start + half, length - half, 1
    else:
        exact_at, exact_n, exact_step, walk_at, walk_n, walk_step = start + half, length - half, 1, start + half - 1, half, -1
    who = np.arange(len(start))
    lo, size = [np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)], np.full(len(start), index.n)
    for t in range(int(exact_n.max(initial=-1)) + 1):
        on = np.flatnonzero((exact_n[who] >= t) & (size > 0))
        if not len(on):
            break
        mine = who[on]
        c = np.where(t < exact_n[mine], flat[np.clip(exact_at[mine] + exact_step * t, 0, len(flat) - 1)], 0)
        new, new_size = index.extend(1 - side, _pick(lo, on), size[on], c)
        lo[0][on], lo[1][on], size[on] = new[0], new[1], new_size
    none = np.zeros(0, np.int64)
    clean = (who[size > 0], _pick(lo, size > 0), size[size > 0])
    wrong = (none, [none, none], none)
    found_who, found_row = [], []
    for t in range(int(walk_n.max(initial=-1)) + 1):
        if not len(clean[0]) and not len(wrong[0]):
            break

        def symbol(w, t=t):
            return np.where(t < walk_n[w], flat[np.clip(walk_at[w] + walk_step * t, 0, len(flat) - 1)], 0)

        then = []
        if len(clean[0]):
            w, lo, size = clean
            state, c, new, new_size = index.extend_all(side, lo, size)
            other = c != symbol(w)[state]
            state, new, new_size = state[other], _pick(new, other), new_size[other]
            wrong = _join(wrong, (w[state], new, new_size))                        # one more letter in the text
            more = t < walk_n[w[state]]
            then.append((w[state][more], _pick(new, more), new_size[more]))        # another letter
            more = t < walk_n[w]
            then.append((w[more], _pick(lo, more), size[more]))                    # one letter less
            new, new_size = index.extend(side, lo, size, symbol(w))
            on = (new_size > 0) & more
            clean = (w[on], _pick(new, on), new_size[on])
        w, lo, size = wrong
        new, new_size = index.extend(side, lo, size, symbol(w))
        done = (t == walk_n[w]) & (new_size > 0)
        found_who.append(w[done])
        found_row.append(new[LEFT][done])
        on = (t < walk_n[w]) & (new_size > 0)
        wrong = _join((w[on], _pick(new, on), new_size[on]), *then)
    if not found_who:
        return none, none
    pairs = np.unique(np.stack([np.concatenate(found_who), np.concatenate(found_row) - 1]), axis=1)
    return pairs[0], pairs[1]


def near_in_block(texts: list[str], patterns: list[list[str]]) -> list[tuple[str, str]]:
    """``(pattern, text)`` one error apart: ``patterns[0]`` with the error in
    the second half, ``patterns[1]`` in the first half and in no second half."""
    if not texts:
        return []
    index = Index(texts)
    unknown = index.n_symbols + 1      # a letter that no text has
    out = []
    for side, mine in ((RIGHT, patterns[0]), (LEFT, patterns[1])):
        for at in range(0, len(mine), PATTERNS):
            part = mine[at:at + PATTERNS]
            length = np.array([len(w) for w in part], np.int64)
            flat = np.array([index.code.get(ch, unknown) for w in part for ch in w], np.int64)
            p, t = search(index, flat, np.cumsum(length) - length, length, side)
            for i, k in zip(p.tolist(), t.tolist(), strict=True):
                word, text = part[i], index.words[k]
                if side == RIGHT or not text.startswith(word[:len(word) // 2]):
                    out.append((word, text))
    return out


class _Search:
    """mapInArrow body over rows sorted by (route, part): whole routes gather
    until a block is full; parts of a split route are blocks of their own."""

    def __call__(self, batches):
        self.clear()
        for batch in batches:
            for r in batch.to_pylist():
                unit = (r["route"], r["part"])
                if unit != self.unit:
                    if self.chars > BLOCK_CHARS or r["parts"] > 1 or self.alone:
                        yield from self.flush()
                    self.unit, self.alone = unit, r["parts"] > 1
                if r["is_text"] and r["word"] not in self.texts:
                    self.texts[r["word"]] = r["n"]
                    self.chars += len(r["word"]) + 1
                if r["is_pattern"]:
                    self.patterns[r["kind"]].append(r["word"])
        yield from self.flush()

    def clear(self):
        self.unit, self.alone, self.texts, self.patterns, self.chars = None, False, {}, [[], []], 0

    def flush(self):
        pairs = near_in_block(list(self.texts), self.patterns) if any(self.patterns) else []
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string()),
                                              pa.array([self.texts[b] for _, b in pairs], pa.int64())], names=["word", "near", "near_n"])
        self.clear()


# -- the operator -----------------------------------------------------------
def near_words(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)``: every pair of different words of ``words``
    ``(word, n)`` (distinct, at least five code points) that one inserted,
    deleted or replaced code point tells apart, in both orders, once each."""
    spark = words.sparkSession
    ship_package(spark)
    m = F.char_length("word")
    lengths = words.select("word", "n", F.explode(F.array(m - 1, m, m + 1)).alias("m"), m.alias("own")).where(F.col("m") >= LEAST_LENGTH)
    half = (F.col("m") / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("kind"), F.left("word", half).alias("half")),
                    F.struct(F.lit(1).alias("kind"), F.right("word", F.col("m") - half).alias("half")))
    routed = (lengths.select("word", "n", "m", (F.col("m") == F.col("own")).alias("is_pattern"), F.inline(sides))
              .withColumn("route", F.concat_ws(":", "kind", "m", "half")).drop("half", "m"))
    sizes = routed.groupBy("route").agg(F.count("*").alias("texts"), F.sum(F.char_length("word") + 1).alias("chars"))
    parts = F.greatest(F.ceil(F.col("texts") / ROUTE_WORDS), F.ceil(F.col("chars") / (4 * BLOCK_CHARS)))
    split = sizes.select("route", parts.cast("int").alias("parts")).where("parts > 1")
    placed = (routed.join(split, "route", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
              .withColumn("own_part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")))
    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    rows = placed.select("route", "kind", "parts", "word", "n", "is_pattern", "own_part",
                         F.explode(F.when(F.col("is_pattern"), everywhere).otherwise(F.array("own_part"))).alias("part"))
    rows = rows.select("route", "part", "parts", "kind", "word", "n", (F.col("part") == F.col("own_part")).alias("is_text"), "is_pattern")
    chars = words.agg(F.sum(F.char_length("word") + 1).alias("chars")).first()["chars"] or 0
    # enough tasks that a core has several, and no task has more than 16 full blocks
    tasks = max(3 * spark.sparkContext.defaultParallelism, -(-6 * chars // (16 * BLOCK_CHARS)))
    return (rows.repartition(tasks, "route", "part").sortWithinPartitions("route", "part")
            .mapInArrow(_Search(), "word string, near string, near_n long"))


def group_variants(words: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``words``
    ``(word, n)``.

    ``form`` is the near word of largest ``n`` (ties: the smallest in code
    point order) if its ``n`` is at least twice the word's, else null;
    ``root`` is where following forms ends.  ``n`` doubles with every step, so
    a chain has at most 63 steps and six rounds of pointer doubling.  An empty
    table gives no rows.
    """
    words = land(words.select("word", "n"), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    has_form = -F.col("best.minus_n") >= 2 * F.col("n")
    forms = land(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best.near")).alias("form"),
        F.when(has_form, -F.col("best.minus_n")).alias("form_n")), "spelling-forms")
    steps = land(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = land(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                           F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(steps)
        steps = moved
        if moved.where("moved").isEmpty():
            break
    return forms.join(steps.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
