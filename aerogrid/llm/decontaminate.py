"""Benchmark decontamination: a broadcast hash set of normalised test n-grams
against every token window of the training texts.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid.llm.common import ascii_lower, free_name, land

#: What stands between words: runs of ASCII other than a-z and 0-9.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same runs in a text whose A-Z are not lower-cased yet, with what stands before them.
SPACED_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
AFTER_LAST = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$"
#: A test set of up to so many windows and characters is broadcast; a larger one is joined by shuffle.
BROADCAST_WINDOWS, BROADCAST_CHARS = 2_000_000, 256 << 20


def words(text: Column) -> Column:
    """Normalised words of a text; none for null."""
    # a split costs a quarter of extracting every match; only its ends can be empty
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def windows(tokens: Column, length: int) -> Column:
    """Array of ``(pos, len, gram)`` for all runs of ``length`` words, the words joined by spaces."""
    run = F.transform(F.sequence(F.lit(0), F.size(tokens) - length), lambda i: F.struct(
        i.alias("pos"), F.lit(length).alias("len"), F.array_join(F.slice(tokens, i + 1, length), " ").alias("gram")))
    return F.when(F.size(tokens) >= length, run).otherwise(F.array().cast("array<struct<pos:int,len:int,gram:string>>"))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
                      window: int = 10) -> DataFrame:
    """Distinct ``(gram, len, items)``: windows of ``window`` words, or the
    whole item if it has fewer (but any), and the items that hold each."""
    tokens = benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(window))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - size),
                        lambda i: F.array_join(F.slice("w", i + 1, size), " "))
    return (tokens.select("item", size.alias("len"), F.explode(F.array_distinct(grams)).alias("gram"))
            .groupBy("gram", "len").agg(F.collect_set("item").alias("items")))


def item_sets(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(gram, len, set_key)`` and ``(set_key, item)``: windows of one prompt
    share their set of items, which is held once, as rows."""
    keyed = grams.withColumn("items", F.array_sort("items")).withColumn(
        "set_key", F.unhex(F.sha2(F.to_json(F.struct("items")).cast("binary"), 256)))
    members = keyed.groupBy("set_key").agg(F.first("items").alias("items")).select("set_key", F.explode("items").alias("item"))
    return keyed.select("gram", "len", "set_key"), members


def anchor(length: Column | int, first: Column, middle: Column, last: Column) -> Column:
    return F.xxhash64(F.lit(length) if isinstance(length, int) else length, first, middle, last)


def scan_by_anchors(slim: DataFrame, known: DataFrame, lens: list[int]) -> DataFrame:
    """``(id, text_key, n_words, pos, len, set_key)`` of the occurring windows,
    and for each row of ``slim`` one with ``pos`` -1.

    Word hashes are exploded beside themselves shifted to a window's middle
    and end.  Where these three meet an anchor of the broadcast set, the
    window's words are joined to its text and looked up themselves: the hash
    only chooses what is verified.  All of it is one stage without a shuffle."""
    shifts = sorted({0} | {n // 2 for n in lens} | {n - 1 for n in lens})
    hashed = slim.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    beside = F.arrays_zip(*[F.slice("h", s + 1, F.size("h")) for s in shifts]).cast(
        f"array<struct<{','.join(f's{s}:bigint' for s in shifts)}>>")
    nothing = F.array(F.struct(*[F.lit(None).cast("bigint").alias(f"s{s}") for s in shifts]))
    rows = hashed.select("id", "text_key", "w", F.posexplode(F.concat(nothing, beside)).alias("at", "x"))
    start = F.array(F.struct(F.lit(0).alias("len"), F.lit(0).cast("bigint").alias("key")))
    keys = F.array(*[F.struct(F.lit(n).alias("len"), F.when(F.col(f"x.s{n - 1}").isNotNull(), anchor(
        n, F.col("x.s0"), F.col(f"x.s{n // 2}"), F.col(f"x.s{n - 1}"))).alias("key")) for n in lens])
    rows = rows.select("id", "text_key", "w", (F.col("at") - 1).alias("pos"), F.explode(F.when(F.col("at") == 0, start).otherwise(keys)).alias("k"))
    rows = rows.select("id", "text_key", "w", "pos", "k.len", "k.key")
    words_of = F.split("gram", " ")

    def word(i: Column) -> Column:
        return F.xxhash64(F.get(words_of, i))

    anchors = known.where("len > 0").select(anchor(F.col("len"), word(F.lit(0)), word((F.col("len") / 2).cast("int")),
                                                   word(F.col("len") - 1)).alias("key")).unionByName(
        known.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("key"))).distinct()
    near = rows.join(F.broadcast(anchors), "key").select(
        "id", "text_key", F.size("w").alias("n_words"), "pos", "len",
        F.when(F.col("pos") < 0, "").otherwise(F.array_join(F.slice("w", F.greatest(F.col("pos") + 1, F.lit(1)), F.greatest("len", F.lit(1))), " ")).alias("gram"))
    return near.join(F.broadcast(known), ["gram", "len"]).drop("gram")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> tuple[DataFrame, DataFrame]:
    """What the scan finds, one row for each id and text: ``(id, text_key,
    copies, n_words, spans, sets)``, and ``(set_key, item)``.

    ``spans`` are the ``(pos, len)`` of occurring windows, ``sets`` the keys of
    the item sets they belong to; repeated rows are counted in ``copies``.  A
    benchmark of bounded size is broadcast as windows and set keys, never with
    the items themselves, and the scan has a row of each text join an empty
    window, so that the texts without a hit stay.  A larger one is joined by
    shuffle on the windows' words, where the texts' own rows take no part.
    """
    grams = land(benchmark_windows(benchmark, item_col, item_text_col, window), "benchmark-windows")
    known, members = item_sets(grams)
    size = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("gram")), F.lit(0)).alias("chars"),
                     F.collect_set("len").alias("lens")).first()
    lens = sorted(size["lens"]) or [1]
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), words(F.col(text_col)).alias("w"))
    if size["n"] <= BROADCAST_WINDOWS and size["chars"] <= BROADCAST_CHARS:
        none = grams.sparkSession.range(1).select(F.lit("").alias("gram"), F.lit(0).alias("len"), F.lit(None).cast("binary").alias("set_key"))
        found = scan_by_anchors(slim, known.unionByName(none), lens)
    else:
        own = slim.select("id", "text_key", F.size("w").alias("n_words"), F.lit(-1).alias("pos"), F.lit(0).alias("len"),
                          F.lit(None).cast("binary").alias("set_key"))
        every = slim.select("id", "text_key", F.size("w").alias("n_words"), F.explode(F.concat(*[windows(F.col("w"), n) for n in lens])).alias("x"))
        found = own.unionByName(every.select("id", "text_key", "n_words", "x.pos", "x.len", "x.gram").join(known, ["gram", "len"]).drop("gram"))
    hit = F.col("pos") >= 0
    return found.groupBy("id", "text_key", "n_words").agg(
        F.count_if(~hit).alias("copies"), F.collect_set(F.when(hit, F.struct("pos", "len"))).alias("spans"),
        F.collect_set("set_key").alias("sets")), members


def hit_positions(spans: Column) -> Column:
    """Distinct word positions inside any of the spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated)``.

    A null or wordless text has no words and no hit; a null or wordless item
    has no window.  An item with a null id marks words as hit but is neither
    counted nor named.  An empty benchmark hits nothing; an empty ``docs``
    gives no row; repeated rows give repeated results.
    """
    found, members = hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    key = ["id", "text_key", "n_words", "copies", "n_hit"]
    found = land(found.withColumn("n_hit", F.size(hit_positions(F.col("spans"))).cast("long")).select(*key, "sets"), "benchmark-hits")
    none = F.array().cast("array<string>")
    clean = found.where("n_hit = 0").select(*key, none.alias("items"))
    pairs = found.where("n_hit > 0").select(*key, F.explode("sets").alias("set_key")).join(members, "set_key", "left")
    dirty = pairs.groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    return clean.unionByName(dirty).select(
        F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), "n_hit",
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
                  remove: str = "documents") -> DataFrame:
    """``docs`` without benchmark passages, with the same columns.

    ``remove="documents"`` drops every row with a hit; ``remove="spans"``
    keeps all rows and takes hit words out of their texts, each with the
    separators before it.  Rows without a hit are untouched, null texts too.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    found = (hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window)[0]
             .where(F.size("spans") > 0)
             .select(F.col("id").alias("hit_id"), F.col("text_key").alias("hit_key"), "spans"))
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col)))
    same = keyed[id_col].eqNullSafe(found["hit_id"]) & (keyed[key] == found["hit_key"])
    if remove == "documents":
        return keyed.join(found, same, "left_anti").select(docs.columns)
    joined = keyed.join(found, same, "left")
    tokens = F.regexp_extract_all(keyed[text_col], F.lit(SPACED_WORD), F.lit(0))
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(tokens) - 1), hit_positions(found["spans"])))
    text = F.concat(F.array_join(F.transform(kept, lambda i: F.element_at(tokens, i + 1)), ""),
                    F.regexp_extract(keyed[text_col], AFTER_LAST, 0))
    cleaned = F.when(found["spans"].isNull(), keyed[text_col]).otherwise(text)
    return joined.select(*[cleaned.alias(c) if c == text_col else keyed[c] for c in docs.columns])
