"""Language identification of mixed-language text.

Each word's letters fall into a script; the scripts a language was learned in
narrow the candidates for a word.  Character n-grams score the word under
each candidate, and a Viterbi pass over the words of a text, with a penalty
for every switch, labels its spans.  The label with the most letters is the
text's language.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from aerogrid.llm.common import append_computed, bounded_slices, filter_texts
from aerogrid.session import ship_package

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: First code points of script ranges, and the script from there on (0: any other).
SCRIPT_STARTS = [0x41, 0x2C0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xB00, 0xB80, 0xC00, 0xE00,
                 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00,
                 0xD7B0, 0xF900, 0xFB00, 0x20000, 0x30000]
SCRIPTS = ["latin", "other", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "bengali",
           "gurmukhi", "other", "tamil", "telugu", "thai", "lao", "georgian", "hangul", "ethiopic", "latin", "greek",
           "other", "hiragana", "katakana", "other", "han", "other", "hangul", "other", "han", "other", "han", "other"]
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS   # hashed n-grams per language
GRAM_MIX = np.uint64(0x9E3779B97F4A7C15)   # an odd multiplier, 2**64 over the golden ratio
LONGEST = 3              # characters in an n-gram
SWITCH = 8.0             # nats for changing the language between two words
CACHE_WORDS = 200_000
BLOCK_WORDS = 2_000_000  # words whose emissions are held at once
SCRIPT_SHARE = 0.01      # of a language's words, for a script to belong to it
WINDOW = 20              # words judged together, whether they are of their label's language at all
EVIDENCE = 8             # words in a learned script that a window needs to be judged
SPREADS = 1.0            # standard deviations of a learned n-gram's log-probability that a window's mean may lie below


def script_of(word: str) -> str:
    """Script of a word's first letter."""
    at = bisect_right(SCRIPT_STARTS, ord(word[0]))
    return SCRIPTS[at - 1] if at else "other"


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all character n-grams of each word between its bounds,
    and for every bucket the number of its word, in order."""
    text = "".join(["^" + w + "$" for w in words])
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))     # characters to the word's end
    found, owner, h = [], [], np.zeros(len(chars), np.uint64)
    for n in range(1, LONGEST + 1):
        h = h[:len(chars) - n + 1] * GRAM_MIX + chars[n - 1:]
        whole = left[:len(h)] >= n
        found.append(((h[whole] * GRAM_MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owner.append(word[:len(h)][whole])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], owner[order]


class _Ids(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = got = len(self)
        return got


class _Count:
    """mapInArrow body of training: ``(lang, kind, key, n)`` sums of one task."""

    def __call__(self, batches):
        words: dict[str, Counter] = {}
        for batch in batches:
            for part in bounded_slices(batch, 0):
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words.setdefault(lang, Counter()).update(WORD.findall((text or "").lower()))
                if sum(map(len, words.values())) > CACHE_WORDS:
                    yield self.sums(words)
                    words = {}
        yield self.sums(words)

    @staticmethod
    def sums(words: dict[str, Counter]) -> pa.RecordBatch:
        langs, kinds, keys, counts = [], [], [], []
        for lang, own in words.items():
            known, n = list(own), np.fromiter(own.values(), np.float64, len(own))
            buckets, owner = gram_buckets(known)
            total = np.bincount(buckets, weights=n[owner], minlength=BUCKETS).astype(np.int64)
            scripts = Counter()
            for w, k in own.items():
                scripts[script_of(w)] += k
            used = np.flatnonzero(total)
            langs += [lang] * (len(used) + len(scripts))
            kinds += ["gram"] * len(used) + ["script"] * len(scripts)
            keys += [str(b) for b in used] + list(scripts)
            counts += total[used].tolist() + list(scripts.values())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(kinds, pa.string()),
                                           pa.array(keys, pa.string()), pa.array(counts, pa.int64())],
                                          names=["lang", "kind", "key", "n"])


@dataclass
class Model:
    """Learned languages, log-probabilities of n-gram buckets and scripts per language."""
    langs: list[str]
    logp: np.ndarray                 # (BUCKETS, languages)
    scripts: dict[str, np.ndarray]   # script -> which languages use it
    least: np.ndarray                # per language: the mean log-probability of an n-gram below which text is not of it


def train(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows with a non-null language.  What reaches the driver
    is at most ``BUCKETS`` counts per language."""
    ship_package(texts.sparkSession)
    rows = texts.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    counts = (rows.mapInArrow(_Count(), "lang string, kind string, key string, n long")
              .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(counts["lang"].to_pylist()))
    index = {lang: i for i, lang in enumerate(langs)}
    grams = np.zeros((BUCKETS, len(langs)))
    scripts: dict[str, np.ndarray] = {}
    table = counts.filter(pc.equal(counts["kind"], "gram"))
    at = np.array([index[x] for x in table["lang"].to_pylist()], int)
    grams[np.array(table["key"].to_pylist(), int), at] = table["n"].to_numpy()
    for row in counts.filter(pc.equal(counts["kind"], "script")).to_pylist():
        scripts.setdefault(row["key"], np.zeros(len(langs)))[index[row["lang"]]] = row["n"]
    words = np.maximum(sum(scripts.values(), np.zeros(len(langs))), 1)
    allowed = {s: n / words >= SCRIPT_SHARE for s, n in scripts.items()}
    logp = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS))
    share = grams / np.maximum(grams.sum(axis=0), 1)
    mean = (share * logp).sum(axis=0)
    spread = np.sqrt((share * (logp - mean) ** 2).sum(axis=0))
    return Model(langs, logp.astype(np.float32), {s: a for s, a in allowed.items() if a.any()}, mean - SPREADS * spread)


class Labeller:
    """Labels of texts under a model; word scores are kept in a bounded cache."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self.forget()

    def forget(self) -> None:
        self.ids = _Ids()
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)
        self.sizes = np.zeros(0, np.int64)
        self.foreign = np.zeros(0, bool)      # in a script that no language uses

    def learn(self) -> None:
        """Score the words that got a number since the last call: the sum of
        their n-grams' log-probabilities, out of reach in a language that does
        not use the word's script while another one does."""
        new = list(islice(self.ids, len(self.scores), None))
        if not new:
            return
        buckets, owner = gram_buckets(new)
        starts = np.searchsorted(owner, np.arange(len(new)))
        score = np.add.reduceat(self.model.logp[buckets], starts, axis=0)
        anywhere = np.ones(len(self.model.langs), bool)
        allowed = np.array([self.model.scripts.get(script_of(w), anywhere) for w in new])
        self.scores = np.concatenate([self.scores, np.where(allowed, score, np.float32(-1e6))])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), np.int64, len(new))])
        self.foreign = np.concatenate([self.foreign, [script_of(w) not in self.model.scripts for w in new]])

    def labels(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the language index and the letters of each word."""
        return [(path, self.sizes[own]) for path, own in self.numbered(texts)]

    def identified(self, texts: list[str | None]) -> list[float]:
        """For each text the share of its letters in words that are of a learned
        language: in a learned script, and in a window of words that is about as
        likely under its labels as what was learned.  A window with few words
        in a learned script is not judged."""
        return [self.share(path, own) for path, own in self.numbered(texts)]

    def share(self, path: np.ndarray, own: np.ndarray) -> float:
        if not len(own):
            return 0.0
        sizes, foreign = self.sizes[own], self.foreign[own]
        grams = LONGEST * (sizes + 2) - LONGEST * (LONGEST - 1) // 2
        over = np.where(foreign, 0.0, self.scores[own, path] - grams * self.model.least[path])
        starts = np.arange(max(len(own) // WINDOW, 1)) * WINDOW               # the last takes the rest
        judged = np.add.reduceat((~foreign).astype(np.int64), starts) >= EVIDENCE
        odd = judged & (np.add.reduceat(over, starts) < 0)
        window = np.minimum(np.arange(len(own)) // WINDOW, len(starts) - 1)
        return float(sizes[~(foreign | odd[window])].sum() / sizes.sum())

    def numbered(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the language index and the number of each word; the
        numbers hold until the next text is asked for."""
        at = 0
        while at < len(texts):
            if len(self.ids) > CACHE_WORDS:
                self.forget()
            ids, n = [], 0
            while at < len(texts) and (n < BLOCK_WORDS or not ids):
                found = WORD.findall((texts[at] or "").lower())
                ids.append(np.fromiter(map(self.ids.__getitem__, found), np.int64, len(found)))
                n += len(found)
                at += 1
            self.learn()
            yield from zip(self.viterbi(ids, self.scores), ids, strict=True)

    def viterbi(self, ids: list[np.ndarray], emit: np.ndarray) -> list[np.ndarray]:
        """Best label sequences of several texts at once, longest first, one
        step for the t-th words of all."""
        order = np.argsort([-len(x) for x in ids], kind="stable")
        lens = np.array([len(ids[i]) for i in order], np.int64)
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64) if len(lens) else lens
        flat = np.concatenate([ids[i] for i in order]) if len(order) else np.zeros(0, np.int64)
        n_langs = len(self.model.langs)
        best = np.zeros(len(flat), np.int16)                  # best language of the word before
        stay = np.zeros((len(flat), n_langs), bool)
        longest = int(lens[0]) if len(lens) else 0
        active = np.searchsorted(-lens, -np.arange(longest), side="left")   # texts longer than t
        score = np.zeros((int(active[0]) if longest else 0, n_langs), np.float64)
        label = np.zeros(len(lens), np.int64)                 # of the last word, then of each before it
        for t in range(longest):
            k = int(active[t])
            at = starts[:k] + t
            score = score[:k]
            if t:
                top = score.argmax(axis=1)
                switched = score[np.arange(k), top][:, None] - self.switch
                best[at] = top
                stay[at] = score >= switched
                score = np.maximum(score, switched)
                score -= switched                             # keeps sums small on long texts
            score = score + emit[flat[at]]
            if t + 1 == longest or int(active[t + 1]) < k:
                done = slice(int(active[t + 1]) if t + 1 < longest else 0, k)
                label[done] = score[done].argmax(axis=1)
        path = np.zeros(len(flat), np.int16)
        for t in range(longest - 1, -1, -1):
            k = int(active[t])
            at = starts[:k] + t
            path[at] = label[:k]
            if t:
                label[:k] = np.where(stay[at, label[:k]], label[:k], best[at])
        out: list = [None] * len(order)
        for rank, i in enumerate(order):
            out[i] = path[starts[rank]:starts[rank] + lens[rank]]
        return out


class _Predict:
    def __init__(self, model, what: str, min_share: float = 0.0):
        self.model, self.what, self.min_share = model, what, min_share

    def __call__(self):
        self.labeller = Labeller(self.model.value)
        return getattr(self, self.what)

    def summary(self, texts: pa.Array) -> list[tuple[str, float, list[dict]]]:
        langs, out = self.labeller.model.langs, []
        if not langs:
            return [("und", 0.0, [])] * len(texts)
        for path, sizes in self.labeller.labels(texts.to_pylist()):
            if not len(path):
                out.append(("und", 0.0, []))
                continue
            letters = np.bincount(path, weights=sizes, minlength=len(langs))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
            spans = [{"lang": langs[path[a]], "first_word": int(a), "n_words": int(b - a)}
                     for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            top = int(letters.argmax())
            out.append((langs[top], float(letters[top] / letters.sum()), spans))
        return out

    def columns(self, texts: pa.Array) -> list[pa.Array]:
        found = self.summary(texts)
        span = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])
        return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                pa.array([x[2] for x in found], pa.list_(span))]

    def keep(self, texts: pa.Array) -> pa.Array:
        if not self.labeller.model.langs:
            return pa.array([False] * len(texts), pa.bool_())
        return pa.array([share > 0 and share >= self.min_share for share in self.labeller.identified(texts.to_pylist())], pa.bool_())


SPANS = ArrayType(StructType([StructField("lang", StringType()), StructField("first_word", IntegerType()),
                              StructField("n_words", IntegerType())]))


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred``, ``score`` (the share of
    letters in spans of that language) and ``spans`` (runs of words of one
    language, counted from 0).

    A null text, one without letters, or a model without languages gives
    ``und``, 0.0 and no span.  Rows map one to one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", SPANS)]
    return append_computed(docs, text_col, _Predict(shared, "columns"), fields, keep=keep)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_share: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns kept, with at least ``min_share`` of their
    letters in words of learned languages, of one or of many; null and
    letterless texts go, and texts mostly in a script that was not learned or
    far less likely than learned text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_texts(docs, text_col, _Predict(shared, "keep", min_share))
