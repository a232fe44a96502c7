"""Token counts of sections: texts are encoded whole, once, and each token's
character span is joined to the sections it overlaps."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from aerogrid.llm.common import append_computed

#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "majority", "fraction")
#: White space runs from this length on are cut out before the pattern's look-ahead,
#: whose backtracking overflows on them.
LONG_RUN = regex.compile(r"\p{White_Space}{10000,}")


class Encoder:
    """Byte-level BPE from a rank file, with the byte span of every token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.run = tiktoken.Encoding("runs", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        """Tokens of a whole text.  The pattern takes a run of white space as
        one piece, without its last character where a word follows; very long
        runs are cut there and encoded as that piece."""
        out, at = [], 0
        for run in LONG_RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += [self.bpe.encode_to_numpy(text[at:run.start()], disallowed_special=()),
                    self.run.encode_to_numpy(text[run.start():end], disallowed_special=())]
            at = end
        return np.concatenate([*out, self.bpe.encode_to_numpy(text[at:], disallowed_special=())])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token, and the one behind its last.  Tokens
        that share a character's bytes both span it."""
        ends = np.cumsum(self.sizes[self.ids(text)])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        data = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((data & 0xC0) != 0x80) - 1
        return char_of[starts], char_of[ends - 1] + 1


def line_sections(text: str) -> np.ndarray:
    """Starts of the lines; a line ends behind its ``\\n``, so lines cover the text."""
    cuts = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10) + 1
    starts = np.concatenate([[0], cuts]).astype(np.int64)
    return starts[starts < len(text)]


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, n_chars: int, rule: str) -> np.ndarray:
    """Tokens of each section, whose starts cover the text in order.

    ``start``: a token belongs to the section of its first character.
    ``majority``: to that with most of its characters, the earlier of equals.
    ``fraction``: to each by its share of characters.  Whatever the rule, the
    counts of a text add up to its number of tokens.
    """
    bounds = np.concatenate([sections, [n_chars]])
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    counts = np.bincount(first[first == last], minlength=len(sections)).astype(float)
    for i in np.flatnonzero(first != last):                   # boundary-crossing tokens
        over = np.arange(first[i], last[i] + 1)
        chars = np.minimum(bounds[over + 1], ends[i]) - np.maximum(bounds[over], starts[i])
        if rule == "start":
            counts[first[i]] += 1
        elif rule == "majority":
            counts[over[chars.argmax()]] += 1
        else:
            counts[over] += chars / chars.sum()
    return counts


class _Sections:
    def __init__(self, path: str, rule: str):
        self.path, self.rule = path, rule

    def __call__(self):
        self.encoder = Encoder(self.path)
        return self.compute

    def compute(self, texts: pa.Array) -> list[pa.Array]:
        sizes, number, start, n_chars, n_tokens = [], [], [], [], []
        for text in texts.to_pylist():
            if not text:
                sizes.append(0)
                continue
            sections = line_sections(text)
            counts = allocate(*self.encoder.spans(text), sections, len(text), self.rule)
            sizes.append(len(sections))
            number.append(np.arange(len(sections)))
            start.append(sections)
            n_chars.append(np.diff(np.concatenate([sections, [len(text)]])))
            n_tokens.append(counts)
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (number, start, n_chars, n_tokens)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        row = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip([*(y.astype(np.int64) for y in flat[:3]), flat[3].astype(float)], kinds, strict=True)],
                                         names=["section", "start", "n_chars", "n_tokens"])
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), row)]


def section_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "majority") -> DataFrame:
    """One row per line of every text: ``(doc_id, section, start, n_chars,
    n_tokens)``, sections counted from 0, ``start`` in code points.

    Texts are encoded whole and once with the rank file at ``path``.  Null and
    empty texts have no section and give no row; repeated rows and ids give
    repeated results.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    row = StructType([StructField("section", LongType()), StructField("start", LongType()), StructField("n_chars", LongType()),
                      StructField("n_tokens", DoubleType())])
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = append_computed(slim, "text", _Sections(path, rule), [StructField("sections", ArrayType(row))], keep=["doc_id"])
    return found.select("doc_id", F.inline("sections"))
