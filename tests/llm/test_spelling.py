"""Spelling variants against all pairs, the index against plain searching."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from aerogrid.llm import spelling

SCHEMA = "doc_id long, text string, word string, N long, root string"


def one_error(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def slow_vocabulary(rows, least_n=3, every=97) -> dict[str, int]:
    counts: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_n}


def slow_groups(words: dict[str, int]) -> dict[str, tuple]:
    form, near = {}, {}
    for w in words:
        near[w] = [v for v in words if one_error(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def got(df) -> dict[str, tuple]:
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def random_words(rng: random.Random, n: int, letters: str) -> dict[str, int]:
    out = {}
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.choice([5, 5, 6, 7, 8, 12])))
        out[w] = rng.choice([3, 4, 8, 16, 17, 33, 70, 500])
    return out


@pytest.mark.parametrize(("n", "letters"), [(300, "ab"), (400, "abé"), (500, "abcdefÿ×")])
def test_groups_equal_all_pairs(spark, n, letters):
    words = random_words(random.Random(n), min(n, 2 ** 7), letters) if letters == "ab" else random_words(random.Random(n), n, letters)
    words["x" * 300], words["x" * 299] = 9, 40
    df = spark.createDataFrame([(w, c, "clash") for w, c in words.items()], "word string, n long, form string").repartition(5)
    assert got(spelling.group_variants(df)) == slow_groups(words)


def test_split_routes_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "ROUTE_WORDS", 7)
    monkeypatch.setattr(spelling, "BLOCK_CHARS", 200)
    words = random_words(random.Random(2), 250, "abc")
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling.group_variants(df)) == slow_groups(words)
    pairs = [(r["word"], r["near"]) for r in spelling.near_words(df).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in words for b in words if one_error(a, b)}


def test_query_from_texts(spark):
    rng = random.Random(4)
    base = ["alpha", "alphas", "gamma", "Gamma", "größe", "grösse", "straßen", "naïveté", "abc", "abcd", "hello", "hallo", "hullo"]
    rows = [(i, " ".join(rng.choice(base) + rng.choice([" ", ", ", "9", "\n"]) for _ in range(rng.randint(0, 300)))) for i in range(150)]
    rows += [(None, None), (None, "Alpha alpha"), (3, ""), (7, None), (8, "alpha " * 40_000 + "z" * 5000), (8, "12 34 Ωmega")]
    df = spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], SCHEMA).repartition(6)
    words = spelling.vocabulary(df, damage_every=97)
    want = slow_vocabulary(rows)
    assert {r["word"]: r["n"] for r in words.collect()} == want
    assert any(len(w) == 4 for w in base) and all(len(w) >= 5 for w in want)
    assert got(spelling.group_variants(words)) == slow_groups(want)


def test_empty_table(spark):
    assert spelling.group_variants(spelling.vocabulary(spark.createDataFrame([], SCHEMA))).collect() == []


def test_index_counts_every_substring_in_both_directions():
    rng = random.Random(1)
    words = sorted(random_words(rng, 60, "abc"))
    index = spelling.Index(words)
    codes = index.encode(index.words)
    order = spelling.suffix_array(codes)
    text = "$" + "$".join(words) + "$"
    assert [text[i] for i in order] == sorted(text)
    joined = "".join(text)
    for _ in range(200):
        w = "$" + rng.choice(words) + "$"
        i = rng.randrange(len(w) - 1)
        j = rng.randrange(i + 1, len(w) + 1)
        mid = rng.randrange(i, j)
        if w[mid] == "$":
            continue
        lo, size = [np.zeros(1, np.int64), np.zeros(1, np.int64)], np.array([index.n])
        for k in range(mid, j):
            lo, size = index.extend(spelling.RIGHT, lo, size, np.array([index.code.get(w[k], 0)]))
        for k in range(mid - 1, i - 1, -1):
            lo, size = index.extend(spelling.LEFT, lo, size, np.array([index.code.get(w[k], 0)]))
        part = w[i:j]
        assert size[0] == sum(joined.startswith(part, at) for at in range(len(joined)))
        if i == 0 and j == len(w):
            assert index.words[lo[spelling.LEFT][0] - 1] == w[1:-1]
