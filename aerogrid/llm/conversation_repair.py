"""Conversation structure repair by square-root checkpointed dynamic programming.

A conversation's rows become one code each (class of the role's initial, and
whether the row is fine, truncated or must go), and its cheapest edits are a
path through four states: nothing yet, after a system row, after a user row,
after an assistant row.  The rows are sorted once over all conversations and
cut into blocks, so a conversation of any length is many blocks:

1. every block gives a 4 x 4 cost matrix between its entry and exit states;
2. per conversation the matrices give the backward state-cost vector at every
   block end: these are the only vectors kept, the checkpoints;
3. every block recomputes its vectors from its checkpoint (inside a block
   again from checkpoints a square root of its rows apart) and walks forward,
   taking the ASCII-least letter that is tight, from each possible entry
   state;
4. per conversation the exits are chained, which picks one walk per block.

A row's identity is (conversation, turn, role, MD5 of the text); texts are
shuffled once, to be written out in order.
"""

from __future__ import annotations

import hashlib
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid.llm.common import free_name, land
from aerogrid.session import ship_package

SPACE = " \t\n\x0b\x0c\r"
BLOCK_BITS = 12                     # rows of a block: 4,096
INF = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = (USER, USER, ASSISTANT, USER)     # state after the next user or assistant row
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
FINE, CUT, MUST_GO = range(3)
LEGAL = {(0, 1), (1, 2), (2, 1)}    # classes: 0 system, 1 user, 2 assistant, 3 other
ROLES = {USER: "user", ASSISTANT: "assistant"}


# -- the automaton ----------------------------------------------------------
def closed(b: list[int]) -> list[int]:
    """The vector with any number of insertions before the next row."""
    b0, b1, b2, b3 = b
    b2 = min(b2, INSERT + b3)
    b3 = min(b3, INSERT + b2)
    return [min(b0, INSERT + b2), min(b1, INSERT + b2), b2, b3]


def row_edits(code: int) -> list[list[tuple[str, int, int]]]:
    """Per state the edits of one row in ASCII order: (letter, cost, next state)."""
    cls, kind = divmod(code, 3)
    extra = TRUNCATED if kind == CUT else 0
    out = []
    for s in range(4):
        edits = [("D", DELETE, s)]
        if kind != MUST_GO:
            if (cls == 0 and s == START) or (cls == 1 and s != USER) or (cls == 2 and s == USER):
                edits.append(("K", extra, SYSTEM if cls == 0 else AFTER[s]))
            edits.append(("R", REROLE + extra, AFTER[s]))
        out.append(edits)
    return out


EDITS = [row_edits(code) for code in range(12)]
END = closed([0, INF, INF, 0])


def step_back(code: int, copies: int, b: list[int]) -> list[int]:
    """Vector before a row, of which ``copies - 1`` repetitions follow, that must go."""
    more = DELETE * (copies - 1)
    return [v if v < INF else INF for v in
            closed([min(cost + b[to] for _, cost, to in edits) + more for edits in EDITS[code]])]


def block_matrix(codes: list[int], copies: list[int]) -> list[int]:
    """Costs from entry state s (with insertions before every row) to exit state t, row by row."""
    columns = []
    for t in range(4):
        b = [INF] * 4
        b[t] = 0
        for code, m in zip(reversed(codes), reversed(copies), strict=True):
            b = step_back(code, m, b)
        columns.append(b)
    return [columns[t][s] for s in range(4) for t in range(4)]


def walk(codes: list[int], copies: list[int], end: list[int], entries: list[int], is_last: bool) -> list[tuple[list[str], int]]:
    """Per entry state the edits' letters, row by row (the last item: what
    follows the last row of a conversation), and the exit state.

    Backward vectors are kept at checkpoints a square root of the rows apart
    and recomputed between two of them on the way forward."""
    n = len(codes)
    stride = isqrt(n) + 1
    marks, b = {n: end}, end
    for i in range(n - 1, -1, -1):
        b = step_back(codes[i], copies[i], b)
        if i % stride == 0:
            marks[i] = b
    states, letters = list(entries), [[] for _ in entries]
    for at in range(0, n, stride):
        to = min(at + stride, n)
        vectors = [marks[to]]
        for i in range(to - 1, at - 1, -1):
            vectors.append(step_back(codes[i], copies[i], vectors[-1]))
        for i in range(at, to):
            here, then = vectors[to - i], vectors[to - i - 1]
            repeats = "D" * (copies[i] - 1)
            for k, s in enumerate(states):
                piece, s = row_walk(codes[i], here, then, s, DELETE * (copies[i] - 1))
                letters[k].append(piece + repeats)
                states[k] = s
    for k, s in enumerate(states):
        tail = ""
        while is_last and end[s] == INSERT + end[AFTER[s]]:
            tail, s = tail + "I", AFTER[s]
        letters[k].append(tail)
        states[k] = s
    return list(zip(letters, states, strict=True))


def row_walk(code: int, here: list[int], then: list[int], s: int, more: int) -> tuple[str, int]:
    """Insertions before a row and its edit: the ASCII-least tight letters (D, I, K, R)."""
    piece = ""
    while True:
        (_, cost, to), *others = EDITS[code][s]
        if cost + more + then[to] == here[s]:
            return piece + "D", to
        if INSERT + here[AFTER[s]] == here[s]:
            piece, s = piece + "I", AFTER[s]
            continue
        for letter, cost, to in others:
            if cost + more + then[to] == here[s]:
                return piece + letter, to
        return piece + "D", s            # an entry state from which no end is reached


# -- tasks ------------------------------------------------------------------
class _Map:
    """mapInArrow body: ``fn(row) -> row`` on dicts, in the schema's types."""

    def __init__(self, fn, schema: pa.Schema):
        self.fn, self.schema = fn, schema

    def __call__(self, batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [self.fn(r) for r in batch.slice(at, 256).to_pylist()]
                yield from pa.Table.from_pylist(rows, schema=self.schema).to_batches()


def _fields(df: DataFrame, names: list[str]) -> tuple[list[pa.Field], str]:
    from pyspark.sql.pandas.types import to_arrow_type
    chosen = [df.schema[n] for n in names]
    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in chosen], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen)


def _map(df: DataFrame, fn, keep: list[str], more: list[pa.Field], ddl: str) -> DataFrame:
    kept, kept_ddl = _fields(df, keep)
    return df.mapInArrow(_Map(fn, pa.schema(kept + more)), f"{kept_ddl}, {ddl}" if keep else ddl)


LONGS = pa.list_(pa.int64())
STEPS = pa.list_(pa.struct([("block", pa.int64()), ("end", LONGS), ("is_first", pa.bool_()), ("is_last", pa.bool_())]))


def _summary(row: dict) -> dict:
    turns = sorted(row["turns"], key=lambda t: t["mid"])
    codes, copies = [t["code"] for t in turns], [t["m"] for t in turns]
    classes = [c // 3 for c in codes]
    illegal = sum(pair not in LEGAL for pair in zip(classes, classes[1:], strict=False)) + sum(copies) - len(copies)
    return {"conv": row["conv"], "block": row["block"], "mids": [t["mid"] for t in turns], "codes": codes, "copies": copies,
            "matrix": block_matrix(codes, copies), "illegal": illegal, "head": classes[0], "tail": classes[-1]}


def _checkpoints(row: dict) -> dict:
    blocks = sorted(row["blocks"], key=lambda b: b["block"])
    illegal = sum(b["illegal"] for b in blocks) + sum(
        (a["tail"], b["head"]) not in LEGAL for a, b in zip(blocks, blocks[1:], strict=False))
    end, steps = END, []
    for k in range(len(blocks) - 1, -1, -1):
        b = blocks[k]
        steps.append({"block": b["block"], "end": end, "is_first": k == 0, "is_last": k == len(blocks) - 1})
        end = [min(min(b["matrix"][4 * s + t] + end[t] for t in range(4)), INF) for s in range(4)]
    return {"conv": row["conv"], "cost": end[START], "illegal": illegal, "steps": steps}


def _walks(row: dict) -> dict:
    entries = [START] if row["is_first"] else [START, SYSTEM, USER, ASSISTANT]
    found = walk(row["codes"], row["copies"], row["end"], entries, row["is_last"])
    return {**{k: row[k] for k in ("conv", "block", "mids", "copies")},
            "pieces": [p for p, _ in found], "exits": [s for _, s in found]}


def _chain(row: dict) -> dict:
    s, steps = START, []
    for k, b in enumerate(sorted(row["blocks"], key=lambda b: b["block"])):
        steps.append({"block": b["block"], "entry": s})
        s = b["exits"][0] if k == 0 else b["exits"][s]
    return {"conv": row["conv"], "entries": steps}


def _decisions(row: dict) -> dict:
    """Per row the letters of its first copy, what is inserted before it and after it, and the roles given."""
    pieces, s, out = row["chosen"], row["entry"], []
    for k, (mid, m) in enumerate(zip(row["mids"], row["copies"], strict=True)):
        piece = pieces[k][:len(pieces[k]) - (m - 1)]
        before, s = _insert(piece.count("I"), s)
        letter = piece[-1]
        if letter == "K":
            role, to = None, (AFTER[s] if row["classes"][k] else SYSTEM)
        elif letter == "R":
            role, to = ROLES[AFTER[s]], AFTER[s]
        else:
            role, to = None, s
        out.append({"mid": mid, "before": before, "letter": letter, "new_role": role, "after": []})
        s = to
    out[-1]["after"], _ = _insert(len(pieces[-1]), s)
    return {"conv": row["conv"], "block": row["block"], "audit": "".join(pieces), "rows": out}


def _insert(n: int, s: int) -> tuple[list[str], int]:
    roles = []
    for _ in range(n):
        s = AFTER[s]
        roles.append(ROLES[s])
    return roles, s


class _Write:
    """Rows sorted by conversation and place: a text, then its decision.  Only
    the current text is held."""

    def __init__(self, conv_type: pa.DataType, turn_type: pa.DataType):
        self.schema = pa.schema([("conv", conv_type), ("pos", pa.int64()), ("turn", turn_type), ("role", pa.string()),
                                 ("text", pa.string()), ("edit", pa.string())])

    def __call__(self, batches):
        conv, pos, text, started = None, 0, "", False
        for batch in batches:
            out, held = [], 0
            for r in batch.to_pylist():
                if not started or r["conv"] != conv:
                    conv, pos, started = r["conv"], 0, True
                if r["letter"] is None:
                    text = r["text"]
                    continue
                for role in r["before"]:
                    out.append((conv, pos, None, role, "", "I"))
                    pos += 1
                if r["letter"] != "D":
                    out.append((conv, pos, r["turn"], r["new_role"] or r["role"], text, r["letter"]))
                    pos += 1
                    held += len(text)
                for role in r["after"]:
                    out.append((conv, pos, None, role, "", "I"))
                    pos += 1
                if held > 4 << 20:
                    yield self.batch(out)
                    out, held = [], 0
            if out:
                yield self.batch(out)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), self.schema.types, strict=True)],
                                          schema=self.schema)


class _Digest:
    """Running SHA-256 of ``role:text`` lines per conversation, over rows in order."""

    def __init__(self, conv_type: pa.DataType):
        self.schema = pa.schema([("conv", conv_type), ("repaired_sha256", pa.string())])

    def __call__(self, batches):
        conv, digest = None, None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if digest is None or r["conv"] != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = r["conv"], hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{r['role']}:{r['text']}".encode())
            if done:
                yield self.batch(done)
        if digest is not None:
            yield self.batch([(conv, digest.hexdigest())])

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(self.schema.types)],
                                          schema=self.schema)


# -- the operator -----------------------------------------------------------
class Repaired(NamedTuple):
    rows: DataFrame       # conv_id, pos, turn, role, text, edit (K kept, R role changed, I inserted)
    summary: DataFrame    # conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit


def _last_char(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> Repaired:
    """Cheapest edits that give every conversation the role initials ``(s?(ua)+)?``.

    Rows are taken by turn (null turns first; rows of one turn by role, then by
    MD5 of the text).  Keep costs 0, a new role 1, Delete 2 (required for blank
    texts and for a role and text seen earlier), Insert 5; a truncated text
    that stays costs 5 more.  Among the cheapest edits the ASCII-least letters
    win.  A null role or text counts as one space, so such a text is blank and
    such a role is foreign; rows of a null conversation form one; repeated rows
    are duplicates; an empty table gives empty results; other columns are not
    read.  ``rows`` lie in order within a partition, one conversation in one
    partition: writing (and hashing) a conversation is a stream of its rows,
    all decisions before it are made per block.
    """
    ship_package(conversations.sparkSession)
    base = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                                F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    base = base.withColumn("h", F.unhex(F.md5(F.col("text").cast("binary"))))
    initial = F.substring("role", 1, 1)
    cls = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    last = _last_char(F.col("text"))
    kind = F.when(last == "", 2).when(last.isin(".", "!", "?"), 0).otherwise(1)
    key = ["conv", "turn", "role", "h"]
    turns = land(base.select(*key, cls.cast("int").alias("cls"), kind.cast("int").alias("kind"))
                 .groupBy(*key, "cls", "kind").agg(F.count("*").alias("m"))
                 .repartitionByRange(*key).sortWithinPartitions(*key)
                 .withColumn("mid", F.monotonically_increasing_id()), "repair-turns")
    firsts = turns.groupBy("conv", "role", "h").agg(F.min("mid").alias("mid")).select("mid", F.lit(True).alias("is_first"))
    is_blank, fresh = F.col("kind") == 2, F.col("is_first").isNotNull()
    coded = land(turns.join(firsts, "mid", "left").select(
        *key, "mid", "m", F.shiftright("mid", BLOCK_BITS).alias("block"), "cls",
        (F.col("cls") * 3 + F.when(is_blank | ~fresh, MUST_GO).otherwise(F.col("kind"))).cast("int").alias("code"),
        F.when(is_blank, F.col("m")).otherwise(0).alias("blank"),
        F.when(~is_blank, F.col("m") - F.when(fresh, 1).otherwise(0)).otherwise(0).alias("duplicate"),
        F.when(~is_blank & fresh & (F.col("kind") == 1), 1).otherwise(0).cast("long").alias("truncated")), "repair-codes")

    blocks = land(_map(coded.groupBy("conv", "block").agg(F.collect_list(F.struct("mid", "code", "m")).alias("turns")), _summary,
                       ["conv", "block"], [pa.field("mids", LONGS), pa.field("codes", LONGS), pa.field("copies", LONGS),
                                           pa.field("matrix", LONGS), *(pa.field(n, pa.int64()) for n in ("illegal", "head", "tail"))],
                       "mids array<long>, codes array<long>, copies array<long>, matrix array<long>, illegal long, head long, tail long"),
                  "repair-blocks")
    ends = land(_map(blocks.groupBy("conv").agg(F.collect_list(F.struct("block", "matrix", "illegal", "head", "tail")).alias("blocks")),
                     _checkpoints, ["conv"], [pa.field("cost", pa.int64()), pa.field("illegal", pa.int64()), pa.field("steps", STEPS)],
                     "cost long, illegal long, steps array<struct<block:long,end:array<long>,is_first:boolean,is_last:boolean>>"),
                "repair-checkpoints")
    steps = ends.select(F.col("conv").alias("c"), F.inline("steps")).withColumnRenamed("block", "b")
    walks = land(_map(blocks.join(steps, blocks["conv"].eqNullSafe(F.col("c")) & (blocks["block"] == F.col("b"))), _walks,
                      ["conv", "block", "mids", "copies"], [pa.field("pieces", pa.list_(pa.list_(pa.string()))), pa.field("exits", LONGS)],
                      "pieces array<array<string>>, exits array<long>"), "repair-walks")
    entries = _map(walks.groupBy("conv").agg(F.collect_list(F.struct("block", "exits")).alias("blocks")), _chain, ["conv"],
                   [pa.field("entries", pa.list_(pa.struct([("block", pa.int64()), ("entry", pa.int64())])))],
                   "entries array<struct<block:long,entry:long>>").select(F.col("conv").alias("c"), F.inline("entries")).withColumnRenamed("block", "b")
    picked = walks.join(entries, walks["conv"].eqNullSafe(F.col("c")) & (walks["block"] == F.col("b"))).select(
        "conv", "block", "mids", "copies", "entry", F.when(F.size("pieces") == 1, F.element_at("pieces", 1)).otherwise(
            F.try_element_at("pieces", (F.col("entry") + 1).cast("int"))).alias("chosen"))
    classes = blocks.select(F.col("conv").alias("c"), F.col("block").alias("b"),
                            F.transform("codes", lambda c: F.floor(c / 3)).alias("classes"))
    rows_type = pa.list_(pa.struct([("mid", pa.int64()), ("before", pa.list_(pa.string())), ("letter", pa.string()),
                                    ("new_role", pa.string()), ("after", pa.list_(pa.string()))]))
    decided = land(_map(picked.join(classes, picked["conv"].eqNullSafe(F.col("c")) & (picked["block"] == F.col("b"))), _decisions,
                        ["conv", "block"], [pa.field("audit", pa.string()), pa.field("rows", rows_type)],
                        "audit string, rows array<struct<mid:long,before:array<string>,letter:string,new_role:string,after:array<string>>>"),
                   "repair-decisions")
    return Repaired(_written(base, coded, decided, key), _summaries(coded, ends, decided))


def _summaries(coded: DataFrame, ends: DataFrame, decided: DataFrame) -> DataFrame:
    n_turns = F.count_distinct("turn")
    counts = coded.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - n_turns, F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")))
    audits = decided.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))),
                                                                  lambda b: b["audit"]), "").alias("audit"))
    e, a = ends.select(F.col("conv").alias("ec"), "cost", "illegal"), audits.withColumnRenamed("conv", "ac")
    return (counts.join(e, counts["conv"].eqNullSafe(F.col("ec"))).join(a, counts["conv"].eqNullSafe(F.col("ac")))
            .select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))


def _written(base: DataFrame, coded: DataFrame, decided: DataFrame, key: list[str]) -> DataFrame:
    one = decided.select(F.inline("rows"))
    made = coded.select(*key, "mid").join(one, "mid").select(
        *key, F.lit(None).cast("string").alias("text"), "before", "letter", "new_role", "after")
    none = F.array().cast("array<string>")
    texts = base.select(*key, "text", none.alias("before"), F.lit(None).cast("string").alias("letter"),
                        F.lit(None).cast("string").alias("new_role"), none.alias("after"))
    both = (texts.unionByName(made).repartition("conv")
            .sortWithinPartitions(*key, F.col("letter").asc_nulls_first()))
    (conv, turn), _ = _fields(base, ["conv", "turn"])
    types = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    return (both.mapInArrow(_Write(conv.type, turn.type),
                            f"conv {types['conv']}, pos long, turn {types['turn']}, role string, text string, edit string")
            .withColumnRenamed("conv", "conv_id"))


def digests(rows: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of ``repair(...).rows``: SHA-256 of its
    ``role:text`` joined by newlines.  Conversations left without rows are
    not there.  Reads the partitions as ``repair`` wrote them, no shuffle."""
    slim = rows.select(F.col("conv_id").alias("conv"), "role", "text")
    (conv,), ddl = _fields(slim, ["conv"])
    return slim.mapInArrow(_Digest(conv.type), f"{ddl}, repaired_sha256 string").withColumnRenamed("conv", "conv_id")


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn`` modulo 20 (a null
    counts as one space): 0 drops the row, 1 empties its text, 2 removes
    ``[.!?]`` from it, 3 repeats the row, 4 makes its role user."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = free_name(conversations, "fault")
    hit = conversations.withColumn(fault, F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20)
    f = F.col(fault)
    out = hit.where(f != 0).select(
        "conv_id", "turn", F.when(f == 4, F.lit("user")).otherwise(text("role")).alias("role"),
        F.when(f == 1, F.lit("")).when(f == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.explode(F.when(f == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return out.drop("copy")


def audit(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the undamaged table: counts, cost, edits and
    digest of the repaired rows of the damaged one.  A conversation without
    rows after the damage has zeros, an empty audit and the empty string's hash."""
    found = repair(damage(conversations))
    s, d = found.summary.withColumnRenamed("conv_id", "sc"), land(digests(found.rows), "repair-digests").withColumnRenamed("conv_id", "dc")
    every = conversations.select("conv_id").distinct()
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (every.join(s, every["conv_id"].eqNullSafe(F.col("sc")), "left").join(d, every["conv_id"].eqNullSafe(F.col("dc")), "left")
            .select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
