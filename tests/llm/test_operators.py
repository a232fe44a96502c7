"""Each operator against a brute-force version on a small fixture with nulls,
empty, long and repeated texts, repeated and null ids, and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
from collections import Counter
from dataclasses import replace
from importlib.resources import files as resources

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from aerogrid.llm import bpe, decontaminate, language_id, license_scan, license_texts, lm_scoring, minhash, quality, simhash, token_counts, url_filter
from aerogrid.llm.components import connected_components
from aerogrid.llm.queries import RULES

BPE_PATH = public_tokenizers.path("word_bpe_49k.json")
RANK_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, fingerprint string, score double, Text_Key string"
LANGS = {"xx": ["alto", "bora", "cine", "dolo"], "yy": ["schrank", "wand", "kraft", "zweig"], "ru": ["дом", "мир", "хлеб", "вода"]}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(LANGS[lang]) + rng.choice(["", "", "n", "e"]) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(3)
    out = [(i, sentence(rng, lang, rng.randint(1, 60)), lang) for i, lang in enumerate(["xx", "yy", "ru"] * 12)]
    long = sentence(rng, "xx", 30_000)
    near = long.split()
    near[500] = "changed"
    out += [(100, long, "xx"), (101, " ".join(near), "xx"), (102, long, None), (103, None, "xx"), (104, "", "yy"),
            (105, " \n\t", None), (106, "12 -- 34 ½", "yy"), (107, "one", None), (107, "one", None), (108, "one", "xx"),
            (None, "one two", "xx"), (None, None, None), (109, "İSTANBUL ΣΑΣ ß <|endoftext|> d'accord\x1c\x85 é", None),
            (110, "alto bora " * 40 + "дом мир " * 40, None), (111, "x" * 3000, None)]
    return [(i, t, lang, "clash", 1.5, "clash") for i, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return repr(x)


# ---------------------------------------------------------------- SimHash --

def slow_simhash(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            votes[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(shingles))


def components(points: list[int], bits: int) -> dict[int, set]:
    left, out = set(points), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            a = todo.pop()
            group.add(a)
            near = {b for b in left if (a ^ b).bit_count() <= bits}
            left -= near
            todo += near
        out.append(group)
    return {p: g for g in out for p in g}


def test_near_duplicates_match_brute_force(docs):
    source = rows()
    prints = [slow_simhash(r[1]) for r in source]
    groups = components(prints, 2)
    expected = [(r[0], p, min((q[0] for q, f in zip(source, prints, strict=True) if f in groups[p] and q[0] is not None), default=None))
                for r, p in zip(source, prints, strict=True)]
    got = [(r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_ball_links_connect_exactly_the_near_ones(spark, bits):
    rng = random.Random(bits)
    points = {rng.getrandbits(64) for _ in range(20)}
    for p in list(points):
        q = p
        for _ in range(3):
            for _ in range(rng.randint(1, 3)):
                q ^= 1 << rng.randrange(64)
            points.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    links = simhash.ball_links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), bits)
    roots = {r["node"] % (1 << 64): r["root"] for r in connected_components(links, "a", "b").collect()}
    groups = components(list(points), bits)
    assert all((a in roots and roots.get(a) == roots.get(b)) == (b in groups[a]) for a in points for b in points if a != b)
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= bits for r in links.collect())


def test_keep_one_per_group(docs):
    source = rows()
    prints = [slow_simhash(r[1]) for r in source]
    groups = components(prints, 2)
    kept = simhash.keep_one_per_group(docs).collect()
    assert [f.name for f in docs.schema] == simhash.keep_one_per_group(docs).columns
    assert len(kept) == len({min(g) for g in groups.values()})
    first = {min(groups[p]): min((q[0] is None, q[0] or 0) for q, f in zip(source, prints, strict=True) if f in groups[p]) for p in prints}
    assert all(first[min(groups[slow_simhash(r["text"])])] == (r["doc_id"] is None, r["doc_id"] or 0) for r in kept)


def test_components_of_a_long_chain(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)] + [(100, 100), (None, 3), (200, 201), (200, 201)],
                                  "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(order, 0), 200: 200, 201: 200}


# -------------------------------------------------------------------- BPE --

@pytest.fixture(scope="module")
def codecs():
    return bpe.WordBpe(BPE_PATH), Tokenizer.from_file(BPE_PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aAbeéÉ'sΣß12 \n<|endoftext|>-", max_size=200))
def test_bpe_equals_the_library(codecs, text):
    own, library = codecs
    ids = library.encode(text, add_special_tokens=False).ids
    got = own.encode(text)
    assert list(np.frombuffer(got, "<u4")) == ids
    assert own.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip(docs, codecs):
    def expected(doc_id, text):
        ids = codecs[1].encode(text or "", add_special_tokens=False).ids
        decoded = codecs[1].decode(ids, skip_special_tokens=False)
        return (doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    got = [tuple(r) for r in bpe.round_trip(docs, BPE_PATH).collect()]
    assert sorted(got, key=key) == sorted((expected(r[0], r[1]) for r in rows()), key=key)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, BPE_PATH).collect()}
    assert ids[100] == codecs[1].encode(rows()[36][1], add_special_tokens=False).ids and ids[103] == []


def test_long_words_merge_alike(codecs):
    rng = random.Random(5)
    for n in (bpe.SCAN_PARTS + 1, 700):
        word = "".join(rng.choice("etaoinshr") for _ in range(n))
        assert list(np.frombuffer(codecs[0].encode(word), "<u4")) == codecs[1].encode(word, add_special_tokens=False).ids


# ------------------------------------------------------- decontamination --

def slow_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", lowered)


def slow_contamination(doc, items, window=10):
    words, hit, found = slow_words(doc[1]), set(), set()
    for item_id, text in items:
        w = slow_words(text)
        k = min(len(w), window)
        grams = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1 if w else 0):
            if tuple(words[i:i + k]) in grams:
                hit |= set(range(i, i + k))
                if item_id is not None:
                    found.add(str(item_id))
    return (doc[0], len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)), hit


LONG_ITEM = " ".join(f"w{i}" for i in range(25))
ITEMS = [(1, LONG_ITEM), (2, "Short, ITEM here"), (3, None), (4, "..."), (5, "w3 " + LONG_ITEM), (None, "nameless item of four"), (2, "Short, ITEM here"),
         (10, "Élan Über")]
LEAKY = [(1, "begin " + LONG_ITEM.replace(" ", "; ") + " end"), (2, "a short item HERE! and w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 tail"), (3, None), (4, ""),
         (5, "w4 w5 w6 w7 w8 w9 w10 w11 w12"), (6, LONG_ITEM + " x " + LONG_ITEM), (6, LONG_ITEM + " x " + LONG_ITEM), (6, "clean"),
         (None, "nameless item of four"), (7, "élan über"), (8, "Élan über"), (9, ("w1 " * 5000) + LONG_ITEM)]


@pytest.fixture(scope="module")
def leaky(spark):
    return spark.createDataFrame([(*r, "z") for r in LEAKY], "doc_id long, text string, pos string").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*r, "z") for r in ITEMS], "item_id long, text string, spans string")


def test_contamination_matches_brute_force(leaky, items):
    got = [tuple(r) for r in decontaminate.contamination(leaky, items).collect()]
    assert sorted(got, key=key) == sorted((slow_contamination(r, ITEMS)[0] for r in LEAKY), key=key)


def test_contamination_is_the_same_without_broadcast(leaky, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", -1)
    got = [tuple(r) for r in decontaminate.contamination(leaky, items).collect()]
    assert sorted(got, key=key) == sorted((slow_contamination(r, ITEMS)[0] for r in LEAKY), key=key)


@pytest.mark.parametrize("limit", [2_000_000, -1])
def test_items_that_share_a_prompt(spark, monkeypatch, limit):
    """3,000 items with one prompt: their ids are held once, not with each window or hit."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    prompt = " ".join(f"ask{i}" for i in range(16))
    many = [(i, f"{prompt} {i} answer") for i in range(3000)] + [(5000, "one two")]
    texts = [(1, prompt), (2, f"{prompt} 17 answer and more"), (3, " ".join(prompt.split()[:9])), (4, "it is one two"), (5, None), (2, f"{prompt} 17 answer and more")]
    frames = (spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(many, "item_id long, text string"))
    got = [tuple(r) for r in decontaminate.contamination(*frames).collect()]
    assert {(r[0], r[2], r[3]) for r in got} == {(1, 16, 3000), (2, 18, 3000), (3, 0, 0), (4, 2, 1), (5, 0, 0)} and len(got) == 6
    ids = hashlib.sha256(",".join(sorted(str(i) for i in range(3000))).encode()).hexdigest()
    assert {r[4] for r in got if r[0] in (1, 2)} == {ids}
    known, members = decontaminate.item_sets(decontaminate.benchmark_windows(frames[1]))
    assert "items" not in known.columns and members.count() < 4 * 3001


def test_decontaminate_documents_and_spans(leaky, items):
    kept = decontaminate.decontaminate(leaky, items)
    assert kept.columns == leaky.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=key) == sorted((r for r in LEAKY if not slow_contamination(r, ITEMS)[1]), key=key)
    spans = decontaminate.decontaminate(leaky, items, remove="spans")
    cleaned = sorted(((r["doc_id"], slow_words(r["text"])) for r in spans.collect()), key=key)
    assert cleaned == sorted(((r[0], [w for i, w in enumerate(slow_words(r[1])) if i not in slow_contamination(r, ITEMS)[1]]) for r in LEAKY), key=key)
    assert {r["text"] for r in spans.where("doc_id = 1").collect()} == {"begin end"}
    with pytest.raises(ValueError):
        decontaminate.decontaminate(leaky, items, remove="all")


def test_empty_benchmark_hits_nothing(leaky, items):
    assert not any(r["contaminated"] for r in decontaminate.contamination(leaky, items.limit(0)).collect())


# ------------------------------------------------------------ URL filter --

URLS = [None, "", "nourl", "http://a.org/x", "http://ORG/", "http://org", "http://b.Example.org/es/1?q", "http://example.org/en/12",
        "http://example.org/en/2#/es/", "http://myorg/x", "https://c.com/fr/9", "https://c.com/de/9", "https://c.com/de", "ftp://x.net/fr/1",
        "http://é.net/中/?z#k", "http://a.org/x", "http://u@h.com:80/fr/?x=://y/", "http://only.net?x=/fr/", "x" * 5000] + [
    f"http://h{i}.{tld}/{lang}/{i}" for i in range(6) for tld in ("org", "com", "net") for lang in ("de", "fr", "en")]


def slow_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def slow_model(urls):
    a, counts = url_filter.A, Counter()
    for u in urls:
        s = [url_filter.START] * 2 + [url_filter.ALPHABET.find(c) + 1 for c in "".join(c.lower() if "A" <= c <= "Z" else c for c in u)]
        counts.update((s[i - 2], s[i - 1], s[i]) for i in range(2, len(s)))
    c1, c0 = Counter(), Counter()
    for (x, y, z), n in counts.items():
        c1[y, z] += n
        c0[z] += n
    total, all1, kinds1, all2, kinds2 = sum(c0.values()), Counter(), Counter(), Counter(), Counter()
    for (y, _), n in c1.items():
        all1[y] += n
        kinds1[y] += 1
    for (x, y, _), n in counts.items():
        all2[x, y] += n
        kinds2[x, y] += 1

    def logp(x, y, z):
        p = (c0[z] + 1) / (total + a)
        p = (c1[y, z] + kinds1[y] * p) / (all1[y] + kinds1[y]) if all1[y] else p
        return math.log((counts[x, y, z] + kinds2[x, y] * p) / (all2[x, y] + kinds2[x, y]) if all2[x, y] else p)

    def score(u):
        s = [url_filter.START] * 2 + [url_filter.ALPHABET.find(c) + 1 for c in "".join(c.lower() if "A" <= c <= "Z" else c for c in u)]
        return [logp(*s[i - 2:i + 1]) for i in range(2, len(s))]
    return score


def slow_rule(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def test_url_filter_matches_brute_force(spark):
    source = [(i if i % 7 else None, u, "x") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(source, "page_id long, url string, score string").repartition(3)
    got = url_filter.filter_urls(pages, RULES).collect()
    decided = {u: slow_rule(*slow_parts(u)) for u in URLS}
    models = [slow_model([u or "" for u in URLS if decided[u] and decided[u].action == a]) for a in ("allow", "block")]
    score = {u: round(sum(x - y for x, y in zip(models[0](u or ""), models[1](u or ""), strict=True)) / len(u), 9) if u else 0.0 for u in URLS}
    by = {a: np.array([score[u] for u in URLS if decided[u] and decided[u].action == a]) for a in ("allow", "block")}
    t = (by["allow"].mean() * by["block"].std() + by["block"].mean() * by["allow"].std()) / (by["allow"].std() + by["block"].std())
    expected = [(i, *slow_parts(u), decided[u] and decided[u].name, decided[u].action if decided[u] else "allow" if score[u] >= t else "block")
                for i, u, _ in source]
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(score[u] for u in URLS), abs=1e-7)


def test_url_filter_without_a_class_allows_the_rest(spark):
    pages = spark.createDataFrame([(1, "http://x.net/a"), (2, "http://x.org/a")], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.filter_urls(pages, RULES).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), RULES).collect() == []


# ----------------------------------------------------------- licence scan --

FILES = [("h/a/LICENSE", ["Released under the MIT License."]), ("h/a/b/one.txt", ["some text", None, "more"]),
         ("h/a/b/two.txt", ["intro words here", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0."]),
         ("h/a/b/c/title.html", ["", "This work is licensed under the GNU General Public License, ", "body"]), ("h/a/b/c/x", ["nothing"]),
         ("h/z", ["the license of the long line that is only about a license in passing and goes on for many other words"]),
         (None, ["Released under the MIT License. "]), ("h/q/r", None), ("h/a/b/one.txt", ["again"]), ("top", ["plain"])]


def test_license_scan_and_inheritance(spark):
    files = spark.createDataFrame([(*f, "x") for f in FILES], "path string, lines array<string>, license string")
    got = {r["path"]: tuple(r)[1:] for r in license_scan.scan_licenses(files, "path", "lines").collect()}
    assert len(got) == 9
    assert got["h/a/LICENSE"] == ("MIT", 1.0, "file", None)
    assert got["h/a/b/one.txt"] == ("MIT", 1.0, "inherited", "h/a")
    assert got["h/a/b/two.txt"] == ("Apache-2.0", 1.0, "header", None)       # equal scores: the smaller name
    assert got["h/a/b/c/title.html"][0] == "GPL-3.0" or got["h/a/b/c/title.html"][0] == "GPL-2.0"
    assert got["h/a/b/c/title.html"][2] == "file"
    assert got["h/a/b/c/x"][2:] == ("inherited", "h/a/b/c")
    assert got["h/z"] == got["h/q/r"] == (None, None, None, None)
    assert got[""][:3] == ("MIT", 1.0, "file")
    assert got["top"] == ("MIT", 1.0, "inherited", "")


def test_license_cosine_is_that_of_sparse_vectors(spark):
    weights, other = license_scan.weigh(license_scan.TEMPLATES)
    line = "this file is licensed under the apache license version 2 0"

    def vector(text):
        return {t: weights.get(t, other) for t in license_scan.terms(text)}

    def cosine(a, b):
        dot = sum(a[t] * b[t] for t in a.keys() & b.keys())
        return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    best = max(cosine(vector(line), vector(t)) for _, t in license_scan.TEMPLATES)
    files = spark.createDataFrame([("f", [line])], "file string, lines array<string>")
    got = license_scan.line_scores(files, license_scan.TEMPLATES, 0.3).collect()
    assert [r["score"] for r in got] == [pytest.approx(best, abs=1e-6)]


def test_license_templates_all_match_themselves(spark):
    files = spark.createDataFrame([(f"d{i}/f", [t]) for i, (_, t) in enumerate(license_scan.TEMPLATES)], "path string, lines array<string>")
    got = {r["path"]: r["license"] for r in license_scan.scan_licenses(files, "path", "lines").collect()}
    assert got == {f"d{i}/f": lic for i, (lic, _) in enumerate(license_scan.TEMPLATES)}
    assert license_scan.scan_licenses(files.limit(0), "path", "lines").collect() == []


def test_license_texts_headers_and_wrapped_statements(spark):
    def text(name):
        return (resources("aerogrid.llm") / "licenses" / f"{name}.txt").read_text(encoding="utf-8").split("\n")

    gpl = ["/* This program is free software: you can redistribute it and/or modify", " * it under the terms of the GNU General Public License as published by",
           " * the Free Software Foundation, either version 3 of the License, or", " * (at your option) any later version.",
           " * This program is distributed in the hope that it will be useful,", " * but WITHOUT ANY WARRANTY; without even the implied warranty of",
           " * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the", " * GNU General Public License for more details. */"]
    code = [f"int value{i} = compute{i}(left{i}, right{i});" for i in range(40)]
    want = {f"t/{x}/LICENSE": (text(x), x, "file") for x in license_texts.TEXTS}
    want |= {"m/COPYING": (["MIT License", "", "Copyright (c) 2020 Foo Bar", "", *text("MIT")], "MIT", "file"), "m/src/a.c": (code, "MIT", "inherited"),
             "p/one": (code[:3] + [" ".join(text("MIT"))] + code, "MIT", "header"),             # a whole text in one line amid others
             "g/x.c": (code[:2] + gpl + code, "GPL-3.0", "header"), "w/y": ([*code[:1], "Licensed under the Apache", "License, Version 2.0.", *code], "Apache-2.0", "header"),
             "s/z": (["Copyright 2020 Foo. Licensed under the Apache License, Version 2.0."], "Apache-2.0", "header"),
             "i/q": (["# SPDX-License-Identifier: MIT", *code], "MIT", "header"), "n/none": (code, None, None),
             "k/bsd": (["BSD 3-Clause", *code], "BSD-3-Clause", "file"), "k/mpl": (["Mozilla Public Version 2.0"], "MPL-2.0", "file"),
             "k/short": (["MPL-2.0", "see the licence"], "MPL-2.0", "header"), "k2/german": (["und", "mit.", *code, "see the license"], None, None),
             "n/words": (["this licence text is not a software license of any version or warranty"], None, None)}
    want |= {f"d{i}/t": ([t], lic, "file") for i, (lic, t) in enumerate(license_texts.TITLES)}
    files = spark.createDataFrame([(p, x[0]) for p, x in want.items()], "path string, lines array<string>")
    got = {r["path"]: (r["license"], r["origin"]) for r in license_scan.scan_licenses(files, "path", "lines").collect()}
    assert got == {p: x[1:] for p, x in want.items()}


# ------------------------------------------------------------ language ID --

@pytest.fixture(scope="module")
def language_model(docs):
    return language_id.train(docs)


def test_language_of_clean_and_odd_texts(docs, language_model):
    got = {}
    for r in language_id.predict(docs, language_model, keep=["doc_id", "text", "lang"]).collect():
        assert 0 <= r["score"] <= 1
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"], r["spans"]) == ("und", 0.0, [])
        got[r["doc_id"]] = r
    assert all(got[i]["lang_pred"] == got[i]["lang"] for i in range(36))
    assert [(s["lang"], s["n_words"]) for s in got[110]["spans"]] == [("xx", 80), ("ru", 80)]


def test_viterbi_matches_brute_force(language_model):
    rng = random.Random(9)
    labeller = language_id.Labeller(language_model, switch=3.0)
    texts = [" ".join(sentence(rng, rng.choice(list(LANGS)), 1) for _ in range(n)) for n in (1, 5, 5, 6, 2, 0)]
    for text, (path, sizes) in zip(texts, labeller.labels(texts), strict=True):
        words = language_id.WORD.findall(text.lower())
        emit = [labeller.scores[labeller.ids[w]] for w in words]

        def value(p, emit=emit):
            return sum(float(e[x]) for e, x in zip(emit, p, strict=True)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))

        assert sizes.tolist() == [len(w) for w in words]
        every = np.stack(np.meshgrid(*[range(len(language_model.langs))] * len(words), indexing="ij"), -1).reshape(-1, len(words)) if words else []
        assert not words or value(path.tolist()) == pytest.approx(max(value(p.tolist()) for p in every))


def test_language_of_nothing(empty, docs):
    model = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.predict(docs, model, keep=["doc_id"]).collect()} == {"und"}
    assert language_id.predict(empty, model, keep=["doc_id"]).collect() == []
    kept = language_id.keep_identified(docs, language_id.train(docs)).count()
    assert kept == sum(any(c.isalpha() for c in r[1] or "") for r in rows())


def test_mixed_texts_are_kept_and_unlearned_ones_go(spark):
    stems = {"a1": "al bo ci do ne ra", "b1": "schr wand kraf zwei tz eich", "c1": "ty py ky vy wyn fyr", "ru": "дом мир хлеб вод ст ия"}
    rng = random.Random(12)

    def prose(lang, n):
        return " ".join("".join(rng.choices(stems[lang].split(), k=rng.randint(1, 3))) for _ in range(n))

    learned = [(i, prose(lang, 300), lang) for i, lang in enumerate(list(stems) * 10)]
    texts = {"two": prose("a1", 60) + " " + prose("b1", 60), "three": " ".join(prose(x, 60) for x in ("a1", "b1", "c1")),
             "four": " ".join(prose(x, 40) for x in stems), "halves and a few": " ".join([prose("a1", 60), prose("b1", 8), prose("c1", 60)]),
             "some unlearned": prose("a1", 90) + " καλημερα κοσμε" * 10, "short": "alciq", "one": prose("c1", 25),
             "greek": "καλημερα κοσμε " * 30, "thai": "สวัสดี", "mostly greek": prose("a1", 10) + " καλημερα κοσμε" * 30,
             "salad": " ".join("".join(rng.choices("qxjvgmhuq", k=6)) for _ in range(60)), "digits": "12 -- 3", "null": None}
    docs = spark.createDataFrame(learned, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    found = language_id.keep_identified(spark.createDataFrame(list(texts.items()), "name string, text string"), model)
    assert {r["name"] for r in found.collect()} == {"two", "three", "four", "halves and a few", "some unlearned", "short", "one"}
    top = {r["name"]: r["score"] for r in language_id.predict(spark.createDataFrame(list(texts.items()), "name string, text string"), model, ["name"]).collect()}
    assert top["three"] < 0.5 and top["halves and a few"] < 0.5 and top["greek"] > 0.5      # the top language's share says otherwise
    assert language_id.keep_identified(docs, model).count() == len(learned)


# ------------------------------------------------------------ fingerprints --

def test_fingerprint_edits_match_brute_force(docs):
    hasher = minhash.MinHash()
    got = minhash.fingerprint_edits(docs).collect()
    tie = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) h").collect()}
    source = sorted(((r[0] is not None, r[0] or 0, tie[r[1]], r[1] or "") for r in rows()))
    expected = []
    for here, after in zip(source, source[1:] + source[:1], strict=True):
        text, following = here[3], after[3]
        changed = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        a, b, c = hasher.sketch(text), hasher.sketch(changed), hasher.sketch(following)
        expected.append((here[1] if here[0] else None, len(text), hashlib.sha256(changed.encode()).hexdigest(), hasher.pack(a), hasher.pack(b),
                         hasher.likeness(a, b), hasher.likeness(a, c)))
    assert sorted((tuple(r) for r in got), key=key) == sorted(expected, key=key)


def test_likeness_estimates_jaccard():
    rng, hasher, errors = random.Random(2), minhash.MinHash(), []
    for share in (0.0, 0.2, 0.5, 0.8, 0.95):
        words = [f"a{rng.randrange(10 ** 9)}" for _ in range(4000)]
        other = words[:int(share * 4000)] + [f"b{rng.randrange(10 ** 9)}" for _ in range(4000 - int(share * 4000))]
        one, two = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        errors.append(hasher.likeness(hasher.sketch(" ".join(words)), hasher.sketch(" ".join(other))) - len(one & two) / len(one | two))
    assert max(map(abs, errors)) < 0.12
    assert hasher.likeness(hasher.sketch("a b c"), hasher.sketch("A  b c")) == 1.0      # few shingles: densified alike
    assert hasher.likeness(hasher.sketch("a b c"), hasher.sketch("d e f")) < 0.2


def test_fingerprints_of_one_row_and_of_none(spark, empty):
    one = minhash.fingerprint_edits(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).collect()
    assert [(r["n_chars"], r["edited_sha256"], r["near_next"]) for r in one] == [(7, hashlib.sha256(b"a b a b").hexdigest(), 1.0)]
    assert minhash.fingerprint_edits(empty).collect() == []


# -------------------------------------------------------------- LM scores --

def test_pseudo_likelihood_matches_a_slow_sum(docs):
    model = lm_scoring.train(docs, top_words=20)
    words = Counter(w for r in rows() for w in lm_scoring.tokens(r[1]))
    top = sorted(words, key=lambda w: (-words[w], lm_scoring.word_hash(w)))[:20]
    assert model.vocabulary.top.tolist() == [lm_scoring.word_hash(w) for w in top]
    k = model.vocabulary.size
    table = model.logp.reshape(k + 1, k + 1, k)
    assert np.allclose(np.exp(table).sum(axis=2), 1, atol=1e-4)
    tail, place = [w for w in words if w not in top], lambda w: lm_scoring.word_hash(w) % len(model.shares)
    symbol = lambda w: top.index(w) if w in top else 20 + lm_scoring.word_hash(w) % lm_scoring.TAIL

    def share(w):
        if w in top:
            return 0.0
        same = [words[v] for v in tail if place(v) == place(w)]
        return math.log(sum(same) / len(same) / sum(words[v] for v in tail if symbol(v) == symbol(w)))

    for s in {symbol(w) for w in tail}:     # a symbol's words share all of it
        assert sum(math.exp(share(w)) for w in tail if symbol(w) == s) == pytest.approx(1)
    for r in lm_scoring.score(docs, model, keep=["doc_id", "text"]).collect():
        found = lm_scoring.tokens(r["text"])
        ids = [k, *map(symbol, found), k]
        slow = sum(float(table[ids[i], ids[i + 2], ids[i + 1]]) + share(w) for i, w in enumerate(found))
        assert r["n_tokens"] == len(found) and r["pll"] == pytest.approx(slow, rel=1e-5, abs=1e-4)


def test_rare_words_cost_more_than_prose(spark):
    """Every word has a probability of its own: a salad of words seen once scores below prose, unseen words below that."""
    rng = random.Random(5)
    prose = [sentence(rng, "xx", 60) for _ in range(60)]
    made = ["".join(rng.choices("bcdfghjk", k=12)) for _ in range(120)]
    salad = " ".join(made[:60])
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*prose, salad])], "tokens long, text string")
    model = lm_scoring.train(frame, top_words=2)
    unseen = spark.createDataFrame([(100, " ".join(made[60:]))], "tokens long, text string")
    got = {r["tokens"]: r["pll_per_token"] for r in lm_scoring.score(frame.unionByName(unseen), model, keep=["tokens"]).collect()}
    assert min(got[i] for i in range(60)) > got[60] + 1 and got[100] < min(got[i] for i in range(60))
    assert len(model.shares) >= 4 * 60


@pytest.mark.parametrize("pair_words", [None, 6, 100_000])
def test_pairs_match_a_slow_mixture(docs, pair_words):
    """Every token from the words beside it: discounted shares after the left and before the right word, the rest from the network."""
    plain, model = lm_scoring.train(docs, top_words=20), lm_scoring.train(docs, top_words=20, pair_words=pair_words)
    texts = [lm_scoring.tokens(r[1]) for r in rows()]
    words = Counter(w for t in texts for w in t)
    n = math.isqrt(words.total()) if pair_words is None else pair_words
    known = set(sorted(words, key=lambda w: (-words[w], lm_scoring.word_hash(w)))[:n])
    pairs = Counter(p for t in texts for p in zip(t, t[1:]))
    sides = [Counter(), Counter()]
    for p, c in pairs.items():
        sides[0][p[0]] += c
        sides[1][p[1]] += c
    kept = {p: c for p, c in pairs.items() if c >= 2 and known.issuperset(p)}
    given = [Counter(), Counter()]      # what the kept pairs of a word take
    for p, c in kept.items():
        for i in (0, 1):
            given[i][p[i]] += (c - lm_scoring.DISCOUNT) / sides[i][p[i]]

    def side(i, at, other, base):
        pair = (at, other) if i == 0 else (other, at)
        own = (kept[pair] - lm_scoring.DISCOUNT) / sides[i][at] if pair in kept else 0.0
        return own + (1 - (given[i][at] if at else 0.0)) * base

    assert len(kept) > 5
    for r in lm_scoring.score(docs, model, keep=["doc_id", "text"]).collect():
        t = lm_scoring.tokens(r["text"])
        base = np.exp(plain.token_logp(np.array([lm_scoring.word_hash(w) for w in t], np.int64), np.array([len(t)])), dtype=np.float64)
        around = [None, *t, None]
        slow = sum(math.log((side(0, around[i], w, b) + side(1, around[i + 2], w, b)) / 2) for i, (w, b) in enumerate(zip(t, base)))
        assert r["n_tokens"] == len(t) and r["pll"] == pytest.approx(slow, rel=1e-5, abs=1e-4)


def test_words_beyond_the_symbols_are_predicted_from_their_neighbours(spark):
    """The same words in the corpus's order and shuffled: apart by far, though none is among the most frequent."""
    rng = random.Random(9)
    made = ["".join(rng.choices("bcdfghjk", k=9)) for _ in range(400)]
    phrases = [" ".join(made[i:i + 4]) for i in range(0, 400, 4)]
    frame = spark.createDataFrame([(i, " ".join(rng.sample(phrases, 20))) for i in range(80)], "doc_id long, text string")
    model = lm_scoring.train(frame, top_words=2, pair_words=None)
    assert model.pairs.words.size == math.isqrt(80 * 80)
    model = lm_scoring.train(frame, top_words=2, pair_words=400)
    tests = spark.createDataFrame([(0, " ".join(phrases[:20])), (1, " ".join(rng.sample(made[:80], 80)))], "doc_id long, text string")
    inside, mixed = [r["pll_per_token"] for r in lm_scoring.score(tests, model, keep=["doc_id"]).orderBy("doc_id").collect()]
    assert inside > mixed + 2


def test_pairs_of_nothing(empty, docs):
    model = lm_scoring.train(empty, pair_words=None)
    assert all(r["pll_per_token"] <= 0 for r in lm_scoring.score(docs, model, keep=["doc_id"]).collect())


def test_network_learns_context():
    k, counts = 4, np.zeros((5, 5, 4), np.int64)
    for left, right, token in ((0, 1, 2), (1, 0, 3), (2, 2, 0), (3, 3, 1)):
        counts[left, right, token] = 100
    logp = lm_scoring.train_network(counts.reshape(-1), k).reshape(5, 5, 4)
    assert all(np.exp(logp[a, b, c]) > 0.9 for a, b, c in ((0, 1, 2), (1, 0, 3), (2, 2, 0), (3, 3, 1)))


def test_lm_of_nothing(empty, docs):
    model = lm_scoring.train(empty)
    assert all(r["pll_per_token"] <= 0 for r in lm_scoring.score(docs, model, keep=["doc_id"]).collect())
    assert lm_scoring.score(empty, model, keep=["doc_id"]).collect() == []


# ---------------------------------------------------------------- quality --

def test_quality_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(4)
    source = [(i, sentence(rng, "xx", 80) if i % 4 else sentence(rng, "xx", 80).upper().replace(" ", "!! ")) for i in range(800)]
    docs = spark.createDataFrame([(*r, 0.0) for r in source] + [(None, None, 0.0), (900, "", 0.0), (900, "", 0.0)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 1) for i in range(0, 800, 2)] + [(3, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, text int")
    model = quality.train(docs, labels.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r for r in quality.predict(docs, model, keep=["doc_id"]).collect()}
    right = [got[i]["predicted"] == int(i % 4 > 0) for i in range(800) if i % 3 == 1]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert quality.predict(docs, model, keep=["doc_id"]).count() == 803
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 550 < kept.count() < 650


def test_quality_without_anything_to_learn(empty, docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert {round(r["score"], 6) for r in quality.predict(docs, model, keep=["doc_id"]).collect()} == {0.5}
    assert quality.predict(empty, quality.train(empty, none), keep=["doc_id"]).collect() == []


def slow_risk(positive, unlabelled, theta, prior):
    """The non-negative unbiased risk of the definition, text by text."""
    loss = lambda x, label: math.log1p(math.exp(-label * sum(a * b for a, b in zip(x, theta, strict=True))))
    mean = lambda rows, label: sum(loss(x, label) for x in rows) / len(rows)
    return (prior * mean(positive, 1) + max(0.0, mean(unlabelled, -1) - prior * mean(positive, -1))
            + quality.RIDGE / 2 * sum(t * t for t in theta))


def test_risk_is_that_of_the_definition():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(0, 1, (60, 3)) + np.repeat([[1.0], [-1.0]], 30, axis=0), np.ones(60)])
    good = np.arange(60) < 12
    halves = lambda theta: quality.Sums.of(x[:25], good[:25], theta) + quality.Sums.of(x[25:], good[25:], theta)
    for prior in (0.2, 0.3, 0.5, 0.6, 0.8):
        theta = quality.minimise(halves, np.zeros(4), prior)
        plus, minus = halves(theta).parts(prior)
        least = slow_risk(x[good], x, theta, prior)
        assert plus + max(0, minus) + quality.RIDGE / 2 * theta @ theta == pytest.approx(least, abs=1e-12)
        assert minus >= 0 and (minus > 0.1) == (prior <= 0.5)    # the last two run into the bound and stop there
        if prior <= 0.5:
            for i in range(4):
                for d in (-1e-2, 1e-2):
                    assert slow_risk(x[good], x, theta + d * np.eye(4)[i], prior) >= least - 1e-9
        assert least <= slow_risk(x[good], x, np.zeros(4), prior)


def test_quality_sums_every_row_whatever_the_partitions(spark):
    """The fit over Spark equals one over the same arrays in memory."""
    words = ["clear prose about rivers and towns.", "BUY NOW!!! $$$ click", "a b c", ""]
    texts = [(i, " ".join([words[(i * 7 + j) % 4 if i % 4 else 1] for j in range(3 + i % 5)]) or None) for i in range(200)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 3) if i % 4] + [(3, 1), (None, 1), (4, 0)], "doc_id long, quality int")
    frame = spark.createDataFrame(texts + [(None, "x y")], "doc_id long, text string")
    one, many = (quality.train(frame.repartition(n), labels) for n in (1, 7))
    x = np.array([quality.features((t or "").encode()) for _, t in texts + [(None, "x y")]]).astype(np.float16).astype(float)
    good = np.array([i % 3 == 0 and i % 4 > 0 for i in range(200)] + [False])
    assert one.mean == pytest.approx(x.mean(axis=0)) and one.prior == pytest.approx(many.prior, abs=0.05)
    local = replace(one, theta=np.zeros(quality.N_FEATURES + 1))
    theta = quality.minimise(lambda t: quality.Sums.of(local.standard(x), good, t), local.theta, 0.5)
    scores = replace(local, theta=theta).score(x)
    classes = [np.bincount(quality._bins(s), minlength=quality.BINS) for s in (scores[good], scores)]
    assert quality.best_bin_prior(*classes) == pytest.approx(one.prior, abs=0.05)
    theta = quality.minimise(lambda t: quality.Sums.of(local.standard(x), good, t), theta, one.prior)
    assert replace(local, theta=theta).score(x) == pytest.approx(one.score(x), abs=1e-3)


def test_prior_needs_no_negatives():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.85):
        scores = np.concatenate([rng.beta(8, 2, int(20_000 * share)), rng.beta(2, 8, 20_000 - int(20_000 * share))])
        count = lambda s: np.bincount(quality._bins(s), minlength=quality.BINS)
        assert quality.best_bin_prior(count(rng.beta(8, 2, 3_000)), count(scores)) == pytest.approx(share, abs=0.06)
    assert quality.best_bin_prior(np.zeros(4), np.ones(4)) == 0.5


# ------------------------------------------------------------ token counts --

def slow_sections(text, rule):
    with open(RANK_PATH, "rb") as f:
        import base64
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    section_of, n = [], 0
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text):
        section_of += [n] * len(line)
        n += 1
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    counts, at = [0.0] * n, 0
    for token in enc.encode_ordinary(text):
        size = len(enc.decode_single_token_bytes(token))
        chars = [section_of[i] for i in sorted(set(char_of[at:at + size]))]
        at += size
        if rule == "fraction":
            for s in chars:
                counts[s] += 1 / len(chars)
        else:
            counts[chars[0] if rule == "start" else max(sorted(set(chars)), key=chars.count)] += 1
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens_match_brute_force(spark, rule):
    texts = ["one line", "a\nb\n\n\n  c d\n", "", None, "\n", "é中🙂\n\n \n\n🙂 x", "tail\n\n\n\n\n", "word " * 3000 + "\n end"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a\nb", 1), (0, "one line", 1)], "doc_id long, text string, section int")
    got = {}
    for r in token_counts.section_tokens(docs, RANK_PATH, rule=rule).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["n_tokens"]))
    for i, t in enumerate(texts[1:], 1):
        assert [x for _, x in sorted(got.get(i, []))] == pytest.approx(slow_sections(t or "", rule))
    assert len(got[0]) == 2 and len(got[None]) == 2
    with pytest.raises(ValueError):
        token_counts.section_tokens(docs, RANK_PATH, rule="other")


def test_very_long_runs_of_space_are_encoded_whole(monkeypatch):
    encoder = token_counts.Encoder(RANK_PATH)
    text = "a b" + " " * 1_000_000 + "x\n" + "\n" * 500_000
    starts, ends = encoder.spans(text)
    assert starts[0] == 0 and ends[-1] == len(text) and (starts[1:] == ends[:-1]).all()
    monkeypatch.setattr(token_counts, "LONG_RUN", token_counts.regex.compile(r"\p{White_Space}{3,}"))
    rng = random.Random(1)
    for _ in range(500):                                   # cut runs give the tokens of the plain pattern
        t = "".join(rng.choice([" ", "   ", "\n", "\x1c", "\x85", "\u3000", "a", "b1", "!", "é"]) for _ in range(rng.randint(0, 14)))
        assert encoder.ids(t).tolist() == encoder.bpe.encode_ordinary(t)


# ------------------------------------------------------------ empty tables --

def test_empty_tables(empty, items):
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one_per_group(empty).collect() == []
    assert bpe.round_trip(empty, BPE_PATH).collect() == [] and token_counts.section_tokens(empty, RANK_PATH).collect() == []
    assert decontaminate.contamination(empty, items).collect() == [] and decontaminate.decontaminate(empty, items).collect() == []
