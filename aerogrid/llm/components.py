"""Connected components by alternating large and small stars (Kiveris et al.,
"Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerogrid.llm.common import land


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node with an edge to another one; ``root`` is
    the smallest node of its component.

    Every step is a partial minimum and a join against a written table, so a
    node with very many neighbours is pre-aggregated on one side and can be
    split by the skew join on the other.  Loops and edges with a null end are
    ignored; an empty input gives an empty result.
    """
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    cur = land(edges.where(F.col(a) != F.col(b)).select(hi, lo).distinct(), "cc-edges")
    seen = None
    while True:
        mark = cur.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(hi, lo))").alias("x")).first()
        if mark["n"] == 0 or mark == seen:
            break
        seen = mark
        cur = _small_star(_large_star(cur))
    roots = cur.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return cur.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def _large_star(cur: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to the smallest of its neighbours and itself."""
    both = cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
        cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    least = land(both.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("lo"), F.least("u", "v").alias("m")), "cc-min")
    return land(cur.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct(), "cc-large")


def _small_star(cur: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    least = land(cur.groupBy("hi").agg(F.min("lo").alias("m")), "cc-min")
    moved = cur.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return land(moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "cc-small")
