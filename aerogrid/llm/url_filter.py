"""URL filter: host/path rules, and for the rest the likelihood ratio of two
character Markov models.  DataFrame functions only.

The models are learned from the URLs that a rule accepts or rejects.  Each is
an interpolated variable-order model (Witten-Bell): a context that was seen
often trusts its own counts, a rare one leans on the shorter context, an
unseen one is the shorter context.  Characters fall into an alphabet of fixed
size ``A``, so a model has at most ``A**3`` rows whatever the input; that
bound is what makes its broadcast safe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerogrid.llm.common import ascii_lower, land

#: Symbols 1 to A - 2; 0 is any other character, A - 1 stands before the first.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&%#:"
A = len(ALPHABET) + 2
START = A - 1


@dataclass(frozen=True)
class Rule:
    """``action`` for the host and its subdomains where the path starts with ``path``."""
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``(name, action)`` of the longest fitting rule, null if none fits; of
    equally long ones the first listed."""
    chosen = F.lit(None).cast("struct<name:string,action:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.action).alias("action"))).otherwise(chosen)
    return chosen


def trigram_codes(text: Column) -> Column:
    """Codes ``(p2 * A + p1) * A + c`` of all characters with the two before each."""
    symbols = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c))
    padded = F.concat(F.array(F.lit(START), F.lit(START)), symbols)
    return F.zip_with(F.zip_with(padded, F.slice(padded, 2, F.greatest(F.size(padded) - 2, F.lit(0))), lambda a, b: a * A + b),
                      symbols, lambda ab, c: F.when(c.isNotNull(), ab * A + c))


def markov_model(counts: DataFrame, n: str) -> DataFrame:
    """``(code, logp)`` on the whole grid from trigram counts in column ``n``."""
    spark = counts.sparkSession
    c, p1 = F.col("code") % A, (F.col("code") / A).cast("long") % A
    grid = (spark.range(A ** 3).select(F.col("id").alias("code")).join(counts.select("code", F.col(n).alias("n")), "code", "left")
            .select("code", (F.col("code") / A).cast("long").alias("ctx2"), p1.alias("ctx1"), c.alias("c"),
                    F.coalesce("n", F.lit(0)).alias("n")))
    pair = grid.groupBy("ctx1", "c").agg(F.sum("n").alias("n1"))
    total = F.sum("n0").over(Window.partitionBy(F.lit(0)))        # A rows
    uni = pair.groupBy("c").agg(F.sum("n1").alias("n0")).select("c", ((F.col("n0") + 1) / (total + A)).alias("p0"))
    ctx1 = Window.partitionBy("ctx1")
    order1 = (pair.join(F.broadcast(uni), "c")
              .select("ctx1", "c", "n1", "p0", F.sum("n1").over(ctx1).alias("all1"),
                      F.sum((F.col("n1") > 0).cast("long")).over(ctx1).alias("kinds1"))
              .select("ctx1", "c", F.when(F.col("all1") > 0, (F.col("n1") + F.col("kinds1") * F.col("p0"))
                                          / (F.col("all1") + F.col("kinds1"))).otherwise(F.col("p0")).alias("p1")))
    ctx2 = Window.partitionBy("ctx2")
    return (grid.join(F.broadcast(order1), ["ctx1", "c"])
            .select("code", "n", "p1", F.sum("n").over(ctx2).alias("all2"),
                    F.sum((F.col("n") > 0).cast("long")).over(ctx2).alias("kinds2"))
            .select("code", F.log(F.when(F.col("all2") > 0, (F.col("n") + F.col("kinds2") * F.col("p1"))
                                         / (F.col("all2") + F.col("kinds2"))).otherwise(F.col("p1"))).alias("logp")))


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``(page_id, host, path, rule, verdict,
    score)``.

    ``rule`` names the longest fitting rule and gives the verdict; where none
    fits, ``allow`` if ``score``, the mean log ratio per character of accepted
    to rejected model, reaches the calibrated threshold.  The threshold lies
    between the mean scores of the URLs accepted and rejected by rules,
    nearer to the class that spreads less.  If either class has no URL there
    is nothing to compare: all undecided ones are allowed.  An empty or null
    URL has score 0.  Repeated rows give repeated results, an empty table none.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = parts(F.col("url"))
    text = ascii_lower(F.coalesce("url", F.lit("")))
    judged = base.select("id", "url", host.alias("host"), path.alias("path")).select(
        "id", "url", "host", "path", best_rule(F.col("host"), F.col("path"), rules).alias("rule"))
    marked = judged.select("id", "url", "host", "path", "rule", trigram_codes(text).alias("codes"))
    learned = marked.where("rule is not null").select(F.col("rule.action").alias("action"), F.explode("codes").alias("code"))
    counts = land(learned.where("code is not null").groupBy("code").agg(
        F.count_if(F.col("action") == "allow").alias("good"),
        F.count_if(F.col("action") == "block").alias("bad")), "url-counts")
    good, bad = markov_model(counts, "good"), markov_model(counts, "bad")
    model = good.join(bad.withColumnRenamed("logp", "bad"), "code").select("code", (F.col("logp") - F.col("bad")).alias("delta"))
    # the row -1 matches once per URL: it keeps empty ones and counts repeated ones
    model = land(model.unionByName(model.sparkSession.range(1).select(F.lit(-1).cast("long").alias("code"), F.lit(0.0).alias("delta"))),
                 "url-model")
    codes = F.concat(F.array(F.lit(-1).cast("long")), F.transform(F.filter("codes", lambda c: c.isNotNull()), lambda c: c.cast("long")))
    scored = land(marked.select("id", "url", "host", "path", "rule", F.explode(codes).alias("code"))
                  .join(F.broadcast(model), "code")       # at most A**3 + 1 rows
                  .groupBy("id", "url", "host", "path", "rule")
                  .agg(F.count_if(F.col("code") < 0).alias("copies"), F.sum("delta").alias("total"),
                       F.count_if(F.col("code") >= 0).alias("chars"))
                  .select("id", "host", "path", "rule", "copies",
                          F.when(F.col("chars") > 0, F.round(F.col("total") / F.col("chars"), 9)).otherwise(0.0).alias("score")),
                  "url-scores")
    threshold = calibrate(scored)
    by_model = F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block")
    return scored.select(F.col("id").alias("page_id"), "host", "path", F.col("rule.name").alias("rule"),
                         F.coalesce(F.col("rule.action"), by_model).alias("verdict"), "score",
                         F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def calibrate(scored: DataFrame) -> float:
    """Threshold from the scores of URLs decided by rules; minus infinity if
    one of the classes is missing."""
    action = F.col("rule.action")
    row = scored.agg(*[f(F.when(action == a, F.col("score"))).alias(f"{a}_{n}")
                       for a in ("allow", "block") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    if row["allow_mean"] is None or row["block_mean"] is None:
        return float("-inf")
    spread = row["allow_sd"] + row["block_sd"]
    if spread == 0:
        return (row["allow_mean"] + row["block_mean"]) / 2
    return (row["allow_mean"] * row["block_sd"] + row["block_mean"] * row["allow_sd"]) / spread
