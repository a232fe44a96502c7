"""The interval join over a table of windows against all pairs, and its planning time."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest

from aerogrid.operators.joins import chunk_windows, in_windows
from aerogrid.operators.ordering import union_windows

START = dt.datetime(2024, 1, 1)


def at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


def windows_of(rng: random.Random, n: int) -> list[tuple]:
    out = []
    for i in range(n):
        a = rng.randrange(0, 40_000)
        out.append((i, at(a), at(a + rng.choice([0, 1, 7, 60, 61, 1440, 10_080, 39_000]))))
    return out + [(n, at(50), at(40)), (n + 1, None, at(5)), (n + 2, at(5), None), (0, out[0][1], out[0][2])]


@pytest.mark.parametrize("hot_rows", [1_000_000, 20])
def test_equals_all_pairs(spark, hot_rows):
    rng = random.Random(3)
    rows = [(i, at(rng.choice([rng.randrange(0, 60_000), 777]))) for i in range(400)] + [(-1, None), (7, at(777)), (7, at(777))]
    wins = windows_of(rng, 60)
    rows += [(1000 + i, t) for i, w in enumerate(wins[:20]) for t in (w[1], w[2]) if t]
    got = in_windows(spark.createDataFrame(rows, "id int, ts timestamp_ntz"),
                     spark.createDataFrame(wins, "window int, start timestamp_ntz, end timestamp_ntz"), hot_rows=hot_rows)
    assert sorted((r["id"], r["ts"], r["window"]) for r in got.collect()) == sorted(
        (i, t, w) for i, t in rows for w, a, b in wins if t is not None and a is not None and b is not None and a <= t <= b)


def test_no_windows_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, at(0))], "id int, ts timestamp_ntz")
    none = spark.createDataFrame([], "window int, start timestamp_ntz, end timestamp_ntz")
    assert in_windows(rows, none).collect() == []
    assert in_windows(rows.limit(0), spark.createDataFrame([(1, at(0), at(9))], none.schema)).collect() == []
    with pytest.raises(ValueError, match="share columns"):
        in_windows(rows, none.withColumnRenamed("window", "ID"))


def test_planning_does_not_grow_with_the_windows(spark):
    rows = spark.createDataFrame([("s", "i", at(60 * h), float(h), h) for h in range(50)],
                                 "station string, indicator string, ts timestamp_ntz, value double, seq long")

    def planned(n: int) -> tuple[float, int]:
        t = time.time()
        df = union_windows(rows, chunk_windows(spark, at(60 * 49), 1, n))
        text = df._jdf.queryExecution().optimizedPlan().toString()
        return time.time() - t, text.count("Relation") + text.count("LogicalRDD") + text.count("Range (")

    planned(5)
    (few, few_nodes), (many, many_nodes) = planned(5), planned(5000)
    assert few_nodes == many_nodes and many < 5 * few + 3
