"""Templates of titles, standard headers and whole licence texts, and their
sparse TF-IDF cosine with runs of consecutive sentences of a file.

A run reaches a cosine of ``c`` with a template only if it holds words of
``c**2`` of the template's squared norm, and it is evidence only if it shares a
word on licences or three words with it; a file that does not is out, and no
other file is.  Since a word
that no template has weighs most, only if such words are at most ``1 / c**2 - 1``
times as many as the others.  What is left of the runs is compared.
"""

from __future__ import annotations

import json
import math
import re
from importlib.resources import files as resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerogrid.llm.common import distinct_words, land

TITLES = [("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"), ("Apache-2.0", "Apache License Version 2.0"),
          ("MPL-2.0", "Mozilla Public License Version 2.0"), ("GPL-3.0", "GNU General Public License Version 3"),
          ("GPL-2.0", "GNU General Public License Version 2"), ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
          ("LGPL-2.1", "GNU Lesser General Public License Version 2.1"), ("BSD-3-Clause", "BSD 3-Clause License"),
          ("BSD-2-Clause", "BSD 2-Clause License")]
GNU = ("This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as "
       "published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. "
       "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
       "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details.")
HEADERS = [("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
            "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
            'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
            "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
            "limitations under the License."),
           ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
           ("GPL-2.0", GNU.format("program", "", 2)), ("GPL-3.0", GNU.format("program", "", 3)),
           ("LGPL-2.1", GNU.format("library", "Lesser ", 2.1)), ("LGPL-3.0", GNU.format("library", "Lesser ", 3)),
           ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.")]
SPDX = ["MIT", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1",
        "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
TEXTS = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0"]
#: Words that speak of licences.  A run is evidence for a template if they share one of these, or three words:
#: "mit" alone reaches a cosine of 0.8 with "MIT License" and is a German preposition.
KEY = r"licen[cs]|copyright|permission|permitted|warrant|redistribut|spdx|cc0"
LEAST_SHARED = 3
BROADCAST_FILES = 1_000_000   # rows of a file number and a few template numbers, about 50 MB
EXACT, RATIO = 8, 1.25   # runs of up to EXACT sentences start at each one; longer ones grow by RATIO and start every 1/EXACT of them


def standard() -> list[tuple[str, str, bool]]:
    """``(license, text, whether it speaks for a directory at the top of a file)``."""
    folder = resources("aerogrid.llm") / "licenses"
    return ([(lic, text, True) for lic, text in TITLES] + [(lic, text, False) for lic, text in HEADERS]
            + [(s.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {s}", False) for s in SPDX]
            + [(lic, (folder / f"{lic}.txt").read_text(encoding="utf-8"), True) for lic in TEXTS])


def constant(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table from a literal of the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def run_scores(files: DataFrame, groups: list[list[tuple[str, str, bool]]], threshold: float) -> DataFrame:
    """``(file, is_title, license, score)``: the best score of every template
    that a run of sentences of a row of ``files`` (columns ``file`` and
    ``lines``, none of them blank; a written table) reaches.  ``is_title``: a title or text whose best run begins the
    file, or that the whole file is.  Each group of templates has term weights
    of its own."""
    from aerogrid.llm.license_scan import terms, weigh
    spark = files.sparkSession
    names, known, others = [], {}, []
    for g, group in enumerate(groups):
        weights, other = weigh([(lic, text) for lic, text, _ in group])
        others.append(other * other)
        for term, w in weights.items():
            known.setdefault(term, {"term": term, "speaks": bool(re.search(KEY, term)), "squares": [None] * len(groups), "dots": []})["squares"][g] = w * w
        for lic, text, speaks in group:
            own = {t: weights[t] ** 2 for t in terms(text)}
            total = sum(own.values())
            for t, w in own.items():
                known[t]["dots"].append({"t": len(names), "dot": w / math.sqrt(total), "share": w / total})
            names.append({"t": len(names), "license": lic, "speaks": speaks, "g": g})

    rows = files.withColumn("row", F.monotonically_increasing_id())
    table = F.broadcast(constant(spark, list(known.values()),
                                 "term string, speaks boolean, squares array<double>, dots array<struct<t: int, dot: double, share: double>>"))
    every = F.array_join("lines", "\n")

    def hits_of(some: DataFrame, *keep: str) -> DataFrame:
        return some.select("row", *keep, F.explode(distinct_words(every)).alias("term")).join(table, "term")

    evidence = (F.count("*") >= LEAST_SHARED) | F.bool_or("says")
    may = (hits_of(rows).select("row", F.col("speaks").alias("says"), F.inline("dots")).groupBy("row", "t")
           .agg(F.sum("share").alias("share"), evidence.alias("evidence"))
           .where(F.col("evidence") & (F.col("share") >= threshold ** 2 - 1e-9)).groupBy("row").agg(F.collect_list("t").alias("may")))
    may = land(may, "license-may")       # few rows: files with words of a licence; their number is checked
    rows = land(rows.join(F.broadcast(may) if may.count() <= BROADCAST_FILES else may, "row"), "license-rows")
    of_may = F.exists("dots", lambda d: F.array_contains("may", d["t"]))
    own = hits_of(rows, "may").groupBy("row").agg(F.collect_list("term").alias("own"), F.collect_list(F.when(of_may, F.col("term"))).alias("mine"))
    # split at sentence ends; ``n`` sentences, each with its words
    parts = F.flatten(F.transform("lines", lambda x: F.split(x, r"(?<=[.;:!?])\s+")))
    cut = rows.join(own, "row").select("row", "file", "may", "own", "mine",
                                       F.transform(F.filter(parts, lambda x: F.trim(x) != ""), distinct_words).alias("parts"))
    cut = cut.withColumn("near", F.transform("parts", lambda p: F.arrays_overlap(p, "mine")))
    steps = [*range(1, EXACT + 1)]
    while steps[-1] < 1 << 30:
        steps.append(math.ceil(steps[-1] * RATIO))
    n = F.size("parts")
    sizes = F.array_union(F.filter(F.array(*map(F.lit, steps)), lambda s: s < n), F.array(n))
    runs = (cut.where(n > 0).select("row", "file", "may", "own", "parts", "near", F.explode(sizes).alias("size"))
            .withColumn("at", F.explode(F.expr(f"sequence(1, size(parts) - size + 1, greatest(int(size div {EXACT}), 1))")))
            # without a word of its templates at either end, a shorter run that is tried too has a higher cosine
            .where((F.col("size") > EXACT) | (F.col("size") == n) | (F.element_at("near", F.col("at"))
                                                                     & F.element_at("near", F.col("at") + F.col("size") - 1)))
            .select("row", "file", "may", "own", (F.col("size") == n).alias("whole"), "size", "at", F.array_distinct(F.flatten(F.slice("parts", F.col("at"), F.col("size")))).alias("words"))
            .withColumn("n_own", F.size(F.array_intersect("words", "own")))
            .where((F.size("words") - F.col("n_own")) * threshold ** 2 <= F.col("n_own") * (1 - threshold ** 2) + 1e-9))
    runs = land(runs.drop("own", "n_own"), "license-runs")
    found = (runs.select("row", "file", "may", "whole", "size", "at", F.explode("words").alias("term")).join(table, "term", "left")
             .withColumn("dots", F.filter("dots", lambda d: F.array_contains("may", d["t"]))))
    run = ["row", "file", "whole", "size", "at"]
    norms = found.groupBy(*run).agg(F.array(*[F.sum(F.coalesce(F.col("squares")[g], F.lit(o))) for g, o in enumerate(others)]).alias("norms"))
    dots = (found.select(*run, F.col("speaks").alias("says"), F.inline("dots")).groupBy(*run, "t")
            .agg(F.sum("dot").alias("dot"), evidence.alias("evidence")).where("evidence").drop("evidence"))
    name = F.broadcast(constant(spark, names, "t int, license string, speaks boolean, g int"))
    reached = (dots.join(norms, run).join(name, "t")
               .withColumn("score", F.round(F.col("dot") / F.sqrt(F.element_at("norms", F.col("g") + 1)), 6))
               .where(F.col("score") >= threshold))
    return (reached.groupBy("row", "file", "t", "license", "speaks")
            .agg(F.max("score").alias("score"), F.max_by("at", F.struct("score", -F.col("at"))).alias("at"), F.max("whole").alias("whole"))
            .select("file", (F.col("speaks") & (F.col("whole") | (F.col("at") == 1))).alias("is_title"), "license", "score"))
