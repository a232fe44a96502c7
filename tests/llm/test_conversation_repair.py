"""Conversation repair against exhaustive search and a plain per-conversation version."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from aerogrid.llm import conversation_repair as cr

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
SCHEMA = "conv_id long, turn long, role string, text string, fault int, H string"


def spaceless(text: str) -> str:
    return text.strip(" \t\n\x0b\x0c\r")


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub(r"[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(rows: list[tuple[str, str, str]]) -> tuple[int, str, list[tuple[str, str]]]:
    """Uniform-cost search over (cost, letters): no tables, no blocks.  ``rows``: role, text, fault."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, letters, i, state, out = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, letters, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in NEXT:
                heapq.heappush(queue, (cost + 5, letters + "I", i, role[0], (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 2, letters + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if (state, role[:1]) in NEXT:
                    heapq.heappush(queue, (cost + more, letters + "K", i + 1, role[:1], (*out, (role, text))))
                for new in ("user", "assistant"):
                    if (state, new[0]) in NEXT:
                        heapq.heappush(queue, (cost + more + 1, letters + "R", i + 1, new[0], (*out, (new, text))))
    raise AssertionError


def slow_audit(rows: list[tuple]) -> dict:
    every, groups = {r[0] for r in rows}, {}
    for r in damaged(rows):
        groups.setdefault(r[0], []).append(r)
    out = {}
    for conv in every:
        mine = sorted(groups.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            fault = ""
            if not spaceless(text):
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif spaceless(text)[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            faults.append(fault)
        turns = [r[1] for r in mine if r[1] is not None]
        cost, letters, kept = cheapest([(r[2], r[3], f) for r, f in zip(mine, faults, strict=True)])
        initials = [r[2][:1] for r in mine]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
                     cost, letters, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest())
    return out


def some_rows(seed: int, convs: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        turn = 0
        for _ in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["yes.", "no", "Fine! \n", " ", "", None, "a.b", "what?", "x" * rng.choice([1, 9000]) + "."])
            rows += [(conv, None if rng.random() < 0.05 else turn, role, text)] * rng.choice([1, 1, 1, 1, 2])
            turn += rng.choice([0, 1, 1, 1, 3])
    return rows


def with_extras(rows):
    return [(*r, 7, "clash") for r in rows]


def got(df) -> dict:
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}


def test_query_equals_search(spark):
    rows = some_rows(1, 150)
    df = spark.createDataFrame(with_extras(rows), SCHEMA).repartition(5)
    assert got(cr.audit(df)) == slow_audit(rows)


def test_long_conversation_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK_BITS", 2)
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "same.", ""])) for t in range(400)]
    rows += some_rows(9, 20)[1:]
    rows = [r for r in rows if r[0] is not None]
    assert got(cr.audit(spark.createDataFrame(with_extras(rows), SCHEMA).repartition(3))) == slow_audit(rows)


def test_rows_are_the_repaired_texts(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Hello."), (3, 0, "user", " ")]
    found = cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kept = sorted((r["conv_id"], r["pos"], r["role"], r["text"], r["edit"]) for r in found.rows.collect())
    assert kept == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "Yes.", "K")]
    assert {r["conv_id"]: (r["audit"], r["cost"]) for r in found.summary.collect()} == {1: ("KDK", 2), 2: ("D", 2), 3: ("D", 2)}


def test_one_row_repeated_very_often(spark):
    rows = [(1, 0, "user", "Hi.")] * 5000 + [(1, 1, "assistant", "Yes.")]
    out = cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).summary.first()
    assert (out["duplicate"], out["illegal"], out["cost"]) == (4999, 4999, 9998)
    assert out["audit"] == "K" + "D" * 4999 + "K"


def test_empty_table(spark):
    assert cr.audit(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_walk_from_checkpoints_equals_all_vectors(n):
    rng = random.Random(n)
    codes, copies = [rng.randrange(12) for _ in range(n)], [rng.choice([1, 1, 3]) for _ in range(n)]
    vectors = [cr.END]
    for c, m in zip(reversed(codes), reversed(copies), strict=True):
        vectors.append(cr.step_back(c, m, vectors[-1]))
    vectors.reverse()
    for entry, (letters, _) in zip(range(4), cr.walk(codes, copies, cr.END, [0, 1, 2, 3], True), strict=True):
        s, want = entry, []
        for i in range(n):
            piece, s = cr.row_walk(codes[i], vectors[i], vectors[i + 1], s, 2 * (copies[i] - 1))
            want.append(piece + "D" * (copies[i] - 1))
        assert letters[:-1] == want
    start = [min(m + e for m, e in zip(cr.block_matrix(codes, copies)[4 * s:4 * s + 4], cr.END, strict=True)) for s in range(4)]
    assert start == vectors[0]
