"""Byte-pair encoding over a contiguous array of adjacent ranks.

A word is cut into parts; beside the parts stands the rank of each adjacent
pair.  The smallest rank is sought by scanning, its boundary is deleted and
the two neighbouring ranks are looked up again, until no pair has a rank.
Words repeat, so their ids are kept in a bounded cache per task.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from aerogrid.llm.common import append_computed

NO_RANK = 1 << 60
SCAN_PARTS = 128         # longer words take the heap: the same merges in n log n
CACHE_WORDS = 200_000
#: Up to here all Unicode versions agree on letters, digits and case.
BEYOND_STABLE = regex.compile(r"[^\x00-\u052F]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE
    files: itself where Latin-1 prints it, else the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a JSON vocabulary with word ends.

    ``path`` is a file of the public ``tokenizers`` format: NFC, lower case,
    a split pattern whose matches are kept, byte-level symbols, merges in
    rank order and an end-of-word suffix.  Special strings in a text give
    their own ids; the text between them is normalised piece by piece.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.split = regex.compile(splits[0])
        self.file_normalizer = tokenizers.Tokenizer.from_file(path).normalizer
        self.file_split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(splits[0]), "removed", invert=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
                                           + ")") if self.special else None
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[vocab[a], vocab[b]] = rank, vocab[a + b]
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + self.suffix) for s in symbols]
        self.cache: dict[str, bytes] = {}

    # -- one word ---------------------------------------------------------
    def merge(self, parts: list[int]) -> list[int]:
        """Merge adjacent parts by rank, the leftmost of equal ranks first."""
        if len(parts) > SCAN_PARTS:
            return self._merge_long(parts)
        none = (NO_RANK, -1)
        look = self.ranks.get
        pairs = [look(p, none) for p in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = min(pairs)                       # the scan over adjacent ranks
            if best[0] == NO_RANK:
                break
            i = pairs.index(best)
            parts[i:i + 2] = [best[1]]              # the boundary goes
            del pairs[i]
            if i < len(pairs):
                pairs[i] = look((parts[i], parts[i + 1]), none)
            if i:
                pairs[i - 1] = look((parts[i - 1], parts[i]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(self.ranks[p][0], i, self.ranks[p][1], p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.ranks]
        heapq.heapify(heap)
        alive: list[int | None] = list(parts)

        def push(i: int) -> None:
            j = right[i]
            if i >= 0 and j < n and (found := self.ranks.get((alive[i], alive[j]))):
                heapq.heappush(heap, (found[0], i, found[1], (alive[i], alive[j])))

        while heap:
            _, i, new, pair = heapq.heappop(heap)
            j = right[i]
            if alive[i] is None or j >= n or (alive[i], alive[j]) != pair:
                continue
            alive[i], alive[j], right[i] = new, None, right[j]
            if right[j] < n:
                left[right[j]] = i
            if left[i] >= 0:
                push(left[i])
            push(i)
        return [p for p in alive if p is not None]

    def word_ids(self, word: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        data = word.encode()
        parts = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return np.array(self.merge([p for p in parts if p is not None]), "<u4").tobytes()

    # -- texts ------------------------------------------------------------
    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null: none), four bytes each."""
        if not text:
            return b""
        if self.special_split is None or not any(s in text for s in self.special):
            return self._encode_plain(text)
        return b"".join(int(self.special[piece]).to_bytes(4, "little") if piece in self.special else self._encode_plain(piece)
                        for piece in self.special_split.split(text) if piece)

    def words(self, text: str) -> list[str]:
        """Pre-tokens of the normalised text.  Texts with characters on whose
        class Unicode versions differ are normalised and split by the library,
        so that its version decides."""
        if BEYOND_STABLE.search(text):
            return [w for w, _ in self.file_split.pre_tokenize_str(self.file_normalizer.normalize_str(text))]
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
            if BEYOND_STABLE.search(text):
                return self.words(text)
        # character by character, so a final capital sigma is an ordinary one
        return self.split.findall(text.replace("Σ", "σ").lower())

    def _encode_plain(self, text: str) -> bytes:
        cache, out = self.cache, []
        for w in self.words(text):
            got = cache.get(w)
            if got is None:
                got = self.word_ids(w)
                if len(w) <= 64:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens of the ids, with a space between; special ones included.
        The file names no decoder, and this is what the library then does."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Codec:
    def __init__(self, path: str, what: str):
        self.path, self.what = path, what

    def __call__(self):
        self.bpe = WordBpe(self.path)
        return getattr(self, self.what)

    def digests(self, texts: pa.Array) -> list[pa.Array]:
        n, ids_hash, text_hash = [], [], []
        for text in texts.to_pylist():
            ids = self.bpe.encode(text)
            n.append(len(ids) // 4)
            ids_hash.append(hashlib.sha256(ids).hexdigest())
            text_hash.append(hashlib.sha256(self.bpe.decode(ids).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]

    def ids(self, texts: pa.Array) -> list[pa.Array]:
        found = [np.frombuffer(self.bpe.encode(t), "<u4").astype(np.int32) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, found)])
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every whole text.  Null and empty texts give an
    empty array; rows map one to one, repeated and null ids included."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return append_computed(slim, "text", _Codec(path, "ids"), [StructField("ids", ArrayType(IntegerType(), False))],
                           keep=["doc_id"])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every whole text:
    its ids as little-endian unsigned 32-bit integers, and the text that these
    ids decode to.  Null texts count as empty; rows map one to one."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
              StructField("decoded_sha256", StringType())]
    return append_computed(slim, "text", _Codec(path, "digests"), fields, keep=["doc_id"])
