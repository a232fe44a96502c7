"""Licence scan: sparse TF-IDF cosine of headers and licence files to
templates, then inheritance from the nearest ancestor directory.  DataFrame
functions only.

Every line of a whole file is a candidate header, and so is every run of
consecutive sentences (``license_texts``), compared also with titles, standard
headers and whole licence texts.  Terms are weighted by
their rarity among the templates; a word that no template has weighs as the
rarest.  A line's cosine is bounded from above by the share of its norm in
template words, which is computed in the row itself; only lines whose bound
reaches the threshold are compared with each template.  A licence file (by its name or
its title line) speaks for its directory and all below it, until a nearer
directory has one; a header speaks for its own file alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid.llm.common import distinct_words, land
from aerogrid.llm.license_texts import run_scores, standard

#: Statements by which texts declare their licence.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, version 2.0."),
]
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$"


def terms(text: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", text.lower()))


def weigh(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float]:
    """Weight of each template term, and of any other word."""
    n, df = len(templates), Counter(t for _, text in templates for t in terms(text))
    return {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}, math.log(1 + n) + 1


def html_lines(html: Column) -> Column:
    """Text lines of a page: scripts, styles and comments dropped, inline tags
    joined, any other tag a line end."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "\n")
    text = F.regexp_replace(text, r"(?i)</?(?:b|i|em|strong|span|a|u|small)(?:\s[^>]*)?>", "")
    return F.split(F.regexp_replace(text, r"<[^>]*>", "\n"), r"[\r\n]+")


def line_scores(files: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """``(file, is_title, license, score)``: the best licence of each line of
    ``files`` (columns ``file`` and ``lines``) whose cosine reaches
    ``threshold``.  ``is_title``: the line is the file's first that is not blank."""
    weights, other = weigh(templates)
    squares = F.create_map(*[x for t, w in sorted(weights.items()) for x in (F.lit(t), F.lit(w * w))])
    known = F.array(*[F.lit(t) for t in sorted(weights)])
    lines = (files.select("file", F.posexplode(F.filter("lines", lambda x: F.trim(x) != "")).alias("at", "line"))
             .select("file", "at", distinct_words(F.col("line")).alias("words"))
             .select("file", "at", F.size("words").alias("n"), F.array_intersect("words", known).alias("shared"))
             .where(F.size("shared") > 0)
             .withColumn("inner", F.aggregate("shared", F.lit(0.0), lambda s, t: s + F.element_at(squares, t)))
             .withColumn("norm2", F.col("inner") + (F.col("n") - F.size("shared")) * (other * other))
             .where(F.col("inner") >= F.col("norm2") * (threshold * threshold) - 1e-9))
    scores = F.array(*[F.struct((-cosine(text, weights, F.col("shared"), F.col("norm2"))).alias("minus"), F.lit(lic).alias("license"))
                       for lic, text in templates])
    return (lines.select("file", "at", F.array_min(scores).alias("best"))
            .where(F.col("best.minus") <= -threshold)
            .select("file", (F.col("at") == 0).alias("is_title"), F.col("best.license").alias("license"),
                    (-F.col("best.minus")).alias("score")))


def cosine(template: str, weights: dict[str, float], shared: Column, norm2: Column) -> Column:
    """Cosine of a line (its known terms and squared norm) with one template."""
    own = sorted(terms(template))
    norm = math.sqrt(sum(weights[t] ** 2 for t in own))
    dots = F.create_map(*[x for t in own for x in (F.lit(t), F.lit(weights[t] ** 2 / norm))])
    dot = F.aggregate(F.array_intersect(shared, F.array(*map(F.lit, own))), F.lit(0.0), lambda s, t: s + F.element_at(dots, t))
    return F.round(dot / F.sqrt(norm2), 6)


def scan_licenses(files: DataFrame, path_col: str, lines_col: str, templates: list[tuple[str, str]] | None = None,
                  threshold: float = 0.8) -> DataFrame:
    """One row per distinct path: ``(path, license, score, origin, from_dir)``.

    ``files`` has a path (``a/b/c``) and an array of text lines; the rows of
    one path are read as one file.  ``origin`` is ``header`` or ``file`` for
    a file's own statement, ``inherited`` for that of the nearest ancestor
    directory ``from_dir`` with a licence file, null if there is neither.  Of
    several statements the best score wins, then the smallest licence name.
    With ``templates`` given, the titles, headers and texts of
    ``license_texts`` are left out.
    Null paths and null lines are read as empty; an empty table gives no row.
    """
    groups = [standard()] if templates is None else []
    templates = TEMPLATES if templates is None else templates
    groups.append([(lic, text, False) for lic, text in templates])
    slim = files.select(F.coalesce(F.col(path_col), F.lit("")).alias("file"),
                        F.coalesce(F.col(lines_col), F.array().cast("array<string>")).alias("lines"))
    # the lines are read by both halves and made once
    slim = land(slim.withColumn("lines", F.filter("lines", lambda x: F.trim(x) != "")), "license-lines")
    name = F.element_at(F.split("file", "/"), -1)
    found = line_scores(slim, templates, threshold).unionByName(run_scores(slim, groups, threshold))
    best = F.min_by(F.struct("license", "score"), F.struct((-F.col("score")).alias("s"), F.col("license").alias("l")))
    own = land(found.groupBy("file").agg(best.alias("b"), F.max("is_title").alias("titled")).select(
        "file", "b.license", "b.score", (F.col("titled") | name.rlike(FILE_NAME)).alias("speaks")), "license-own")
    declared = land(own.where("speaks").select(directory(F.col("file")).alias("dir"), "license", "score")
                    .groupBy("dir").agg(F.min_by(F.struct("license", "score"), F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("d"))
                    .select("dir", F.col("d.license").alias("dir_license"), F.col("d.score").alias("dir_score")), "license-dirs")
    paths = slim.select("file").distinct()
    dirs = paths.select(directory(F.col("file")).alias("dir")).distinct()
    nearest = land(dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("up"))
                   .join(declared.withColumnRenamed("dir", "up"), "up")
                   .groupBy("dir").agg(F.max_by(F.struct("up", "dir_license", "dir_score"), F.length("up")).alias("n"))
                   .select("dir", F.col("n.up").alias("from_dir"), F.col("n.dir_license").alias("up_license"),
                           F.col("n.dir_score").alias("up_score")), "license-nearest")
    joined = paths.join(own, "file", "left").withColumn("dir", directory(F.col("file"))).join(nearest, "dir", "left")
    has = F.col("license").isNotNull()
    return joined.select(
        F.col("file").alias("path"), F.coalesce("license", "up_license").alias("license"),
        F.when(has, F.col("score")).otherwise(F.col("up_score")).alias("score"),
        F.when(has, F.when(F.col("speaks"), "file").otherwise("header")).when(F.col("up_license").isNotNull(), "inherited").alias("origin"),
        F.when(~has, F.col("from_dir")).alias("from_dir"))


def directory(path: Column) -> Column:
    """``a/b`` of ``a/b/c``; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(dir_path: Column) -> Column:
    """The directory itself and all above it, the top (empty) not among them
    unless it is the directory."""
    names = F.split(dir_path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, 1, k), "/"))
