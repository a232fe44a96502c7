"""The Jaccard join against all pairs, its bounds against their definitions."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from aerogrid.llm import jaccard_join as jj

SCHEMA = "doc_id long, text string, set_key string, N double, id string"


def shingles(text: str | None, k: int = 3) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i:i + k]) for i in range(max(len(words) - k + 1, 1)))


def slow(rows: list[tuple]) -> list[tuple]:
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 0.8 * len(a) <= len(b) <= 1.25 * len(a) and 100 * len(a & b) >= 90 * len(a | b):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted(((doc, len(s), least[find(i)] if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def some_rows(seed: int, n: int) -> list[tuple]:
    """Families of texts with a few changed words, so that many pairs lie close to 0.9."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows: list[tuple] = []
    while len(rows) < n:
        base = [rng.choice("abcdefgh") * rng.randint(1, 4) + str(rng.randrange(400)) for _ in range(rng.choice([3, 9, 12, 30, 60, 148, 300]))]
        if rng.random() < 0.3:
            base[len(base) // 2:len(base) // 2] = passage
        for _ in range(rng.choice([1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "Word", str(rng.randrange(30))])
            if rng.random() < 0.3:
                copy = copy[:len(copy) - rng.randrange(0, 1 + len(copy) // 12)]
            rows.append((len(rows), rng.choice([" ", "\n", " \t"]).join(copy)))
    rows += [(None, rows[5][1]), (3, rows[9][1]), (7001, None), (7002, ""), (7003, " \n"), (7004, "One"), (7005, "one"), (7006, "one two"),
             (None, None), (7007, "\x1cone"), (7008, "w " * 5000), (7009, "w " * 9000 + "é" * 9000)] + [(8000, "a b c d")] * 3
    return rows


def got(df) -> list[tuple]:
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1.0, "clash") for i, t in rows], SCHEMA).repartition(5)


def test_components_equal_all_pairs(spark):
    rows = some_rows(1, 700)
    assert got(jj.similar_documents(frame(spark, rows))) == slow(rows)


def test_parts_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jj, "PART_SETS", 6)
    rows = some_rows(2, 300)
    assert got(jj.similar_documents(frame(spark, rows))) == slow(rows)


def test_empty_table(spark):
    assert jj.similar_documents(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_linked_sets_share_a_signature(seed):
    rng = random.Random(seed)
    links = jj.Links(90, 100)
    schemes = jj.Schemes(links)
    seen = 0
    for _ in range(1500):
        n = rng.choice([9, 10, 11, 14, 19, 20, 33, 80, 148, 400])
        a = {rng.getrandbits(63) for _ in range(n)}
        b = set(a)
        for _ in range(rng.randrange(0, 2 + n // 9)):
            if rng.random() < 0.6:
                b.discard(rng.choice(sorted(b)))
            else:
                b.add(rng.getrandbits(63))
        if a != b and b and links.holds(len(a & b), len(a), len(b)):
            seen += 1
            one, two = (set(schemes.signatures(np.array(sorted(s), np.uint64)).tolist()) for s in (a, b))
            assert one & two
    assert seen > 300


def test_no_partner_beyond_the_bands():
    links = jj.Links(90, 100)
    for n in range(1, 300):
        partners = [m for m in range(1, 400) if m != n and links.holds(min(m, n), m, n)]
        assert links.lonely(n) == (not partners)
        if partners:
            assert max([n, *partners]) == max(n, links.largest_partner(n))


def test_opened_groups_connect_as_all_pairs():
    rng = random.Random(8)
    links = jj.Links(90, 100)
    base = [rng.getrandbits(62) for _ in range(120)]
    sets = []
    for _ in range(300):
        mine = set(base)
        for _ in range(rng.randrange(0, 14)):
            mine.discard(rng.choice(base))
        mine |= {rng.getrandbits(62) for _ in range(rng.randrange(0, 3))}
        sets.append(np.array(sorted(mine), np.uint64))
    pairs = jj.open_groups(sets, np.zeros(len(sets), int), links)
    want = [(i, j) for i in range(len(sets)) for j in range(i) if links.holds(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]

    def classes(edges):
        label = list(range(len(sets)))
        for a, b in edges:
            old, new = label[a], label[b]
            label = [new if x == old else x for x in label]
        return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}
    assert classes(pairs) == classes(want) and len(pairs) < len(sets)
