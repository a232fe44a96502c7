"""Operators for any number of tables, boxes, chunks and landings, and the jobs, against plain versions."""

from __future__ import annotations

import datetime as dt
import math
import random

import pyarrow.parquet as pq
import pytest

from aerogrid.jobs import predict as predict_job
from aerogrid.jobs import train as train_job
from aerogrid.operators import aggregates as A
from aerogrid.operators import joins as J
from aerogrid.operators.windows import ffill_table
from aerogrid.plans import model as M
from aerogrid.sources import sinks
from aerogrid.sources.tables import table
from aerogrid.streaming import ingest

from conftest import SF_SMALL

START = dt.datetime(2024, 1, 1)


def hours(a: float) -> dt.datetime:
    return START + dt.timedelta(hours=a)



def test_merge_of_many_tables(spark):
    frames = [spark.createDataFrame([(k, f"{i}.{k}") for k in [*range(i, i + 4), None]], f"ts int, c{i} string") for i in range(70)]
    got = {r["ts"]: r for r in J.merge_unique(frames).collect()}
    assert set(got) == {None, *range(73)}
    for k, r in got.items():
        assert [r[f"c{i}"] for i in range(70)] == [f"{i}.{k}" if k is None or i <= k < i + 4 else None for i in range(70)]
    few = J.merge_unique(frames[:2])
    assert few._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert few.columns == ["ts", "c0", "c1"]
    with pytest.raises(Exception, match="repeated key 3"):
        J.merge_unique([frames[0], frames[0].withColumnRenamed("c0", "x").union(spark.createDataFrame([(3, "again")], "ts int, x string"))]).collect()
    with pytest.raises(ValueError, match="share columns"):
        J.merge_unique([frames[0], frames[0]])


@pytest.mark.parametrize("hot", [1_000_000, 10])
def test_points_in_boxes(spark, hot):
    rng = random.Random(hot)
    points = [(i, rng.choice([60.0, rng.uniform(-80, 80)]), rng.uniform(-170, 170)) for i in range(300)] + [(900, None, 1.0), (901, math.nan, 1.0)]
    boxes = []
    for i in range(80):
        a, b = rng.uniform(-80, 80), rng.uniform(-170, 170)
        h, w = rng.choice([0, 0.01, 1, 30, 100]), rng.choice([0, 0.5, 7, 200])
        boxes.append((i, a, a + h, b, b + w))
    boxes += [(80, 60.0, 60.0, -180.0, 180.0), (81, None, 1.0, 0.0, 1.0), (82, 5.0, 1.0, 0.0, 1.0)]
    got = J.in_boxes(spark.createDataFrame(points, "id int, lat double, lon double"),
                     spark.createDataFrame(boxes, "box int, lat_min double, lat_max double, lon_min double, lon_max double"), hot_rows=hot)
    want = {(i, b) for i, y, x in points for b, a, c, d, e in boxes
            if None not in (y, x, a, c, d, e) and a <= y <= c and d <= x <= e}
    rows = [(r["id"], r["box"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 100


@pytest.mark.parametrize("cuts,hot", [(None, 1_000_000), (3, 10), (60, 1_000_000), (400, 10)])
def test_sums_in_boxes(spark, cuts, hot):
    """The sums of the pairs of ``in_boxes``, for any number of strips, frequent coordinates, edges on points and repeated boxes."""
    rng = random.Random(7)
    place = lambda top: rng.choice([0.0, -0.0, 5.0, top / 2, rng.randrange(-9, 9), rng.uniform(-top, top)])
    points = [(place(80), place(170), rng.choice([None, 0.5, rng.randrange(-50, 50)])) for _ in range(400)]
    points += [(None, 1.0, 1.0), (math.nan, 1.0, 1.0), (1.0, math.nan, 1.0), (1.25, 1.25, None)]
    boxes = [(7, 1.25, 1.25, 1.25, 1.25), (8, None, 1.0, 0.0, 1.0), (9, 5.0, 1.0, 0.0, 1.0), (10, -90.0, 90.0, -180.0, 180.0), (11, 85.0, 86.0, 0.0, 1.0)]
    for i in range(90):
        a, b = place(80), place(170)
        boxes.append((rng.choice([None, i + 20]), a, a + rng.choice([0, 1, 5.0, rng.uniform(0, 60)]), b, b + rng.choice([0, 4, rng.uniform(0, 150)])))
    boxes += boxes[20:24]
    want = {}
    for box, a, c, d, e in boxes:
        for y, x, v in points:
            if None not in (y, x, a) and a <= y <= c and d <= x <= e:
                n, total = want.get(box, (0, None))
                want[box] = n + 1, total if v is None else (total or 0.0) + v
    kind = "lat double, lon double, value double", "box int, lat_min double, lat_max double, lon_min double, lon_max double"
    rows = [tuple(None if v is None else float(v) for v in r) for r in points], [(r[0], *(None if v is None else float(v) for v in r[1:])) for r in boxes]
    p, b = (spark.createDataFrame(r, k).repartition(3) for r, k in zip(rows, kind))
    got = J.sums_in_boxes(p, b, "box", "value", cuts=cuts, hot_rows=hot).collect()
    assert {r["box"]: r["n"] for r in got} == {k: n for k, (n, _) in want.items()} and len(got) == len(want) > 25
    assert all(r["total"] == (None if (t := want[r["box"]][1]) is None else pytest.approx(t)) for r in got) and want[7] == (1, None)
    assert J.sums_in_boxes(p.limit(0), b, "box", "value").collect() == J.sums_in_boxes(p, b.limit(0), "box", "value").collect() == []


def test_many_boxes_are_summed_without_their_pairs(spark):
    """Boxes that each hold most points: rows joined one by one stay far below the pairs."""
    rng = random.Random(3)
    points = spark.createDataFrame([(rng.random(), rng.random(), 1.0) for _ in range(4000)], "lat double, lon double, value double")
    boxes = spark.createDataFrame([(i, rng.random() / 4, 1 - rng.random() / 4, rng.random() / 4, 1 - rng.random() / 4) for i in range(500)],
                                  "box int, lat_min double, lat_max double, lon_min double, lon_max double")
    joined, real = [], J.in_boxes
    with pytest.MonkeyPatch.context() as m:
        m.setattr(J, "in_boxes", lambda *a: joined.append(real(*a)) or joined[-1])
        n = sum(r["n"] for r in J.sums_in_boxes(points, boxes, "box", "value").collect())
    assert n == real(points, boxes).count() and len(joined) == 2 and sum(j.count() for j in joined) < n / 5


def test_chunks_are_bounded_and_join_to_the_whole(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), hours(rng.randrange(0, 90)), i) for i in range(400)]
    got = A.collect_chunks(spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq int").repartition(4), "key", ["ts", "seq"], [], size=16).collect()
    assert max(len(r["rows"]) for r in got) == 16
    for k in ("a", "b", None):
        mine = sorted((r for r in got if r["key"] == k), key=lambda r: r["chunk"])
        assert [r["chunk"] for r in mine] == list(range(len(mine))) and all(len(r["rows"]) == 16 for r in mine[:-1])
        assert [(x["ts"], x["seq"]) for r in mine for x in r["rows"]] == sorted((t, i) for key, t, i in rows if key == k)


def test_table_fill_takes_all_columns_at_once(spark):
    rng = random.Random(2)
    rows = [(hours(h * 31), st, *[rng.choice([None, None, rng.random()]) for _ in range(5)]) for h in range(120) for st in "ab"]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, station string, c0 double, c1 double, c2 double, c3 double, c4 double").repartition(3)
    last, want = [None] * 5, {}
    for r in sorted(rows, key=lambda r: r[:2]):
        last = [v if v is not None else old for v, old in zip(r[2:], last, strict=True)]
        want[r[:2]] = tuple(last)
    got = ffill_table(df, [f"c{i}" for i in range(5)], tiebreak=["station"])
    assert got.columns == df.columns
    assert {tuple(r)[:2]: tuple(r)[2:] for r in got.collect()} == want

    def n(cols):
        return ffill_table(df, cols, tiebreak=["station"])._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert n(["c0"]) == n([f"c{i}" for i in range(5)])


def test_stream_keeps_the_first_copy_over_landings_and_restarts(spark, tmp_path):
    events = table(spark, SF_SMALL, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    schema, parts = events.schema, 3
    out, obs = str(tmp_path / "out"), str(tmp_path / "obs")
    rows = events.orderBy("event_id").collect()
    rng = random.Random(4)
    rng.shuffle(rows)                       # a later landing holds earlier arrivals and times
    landed = []
    for no in range(parts):
        mine = rows[no::parts]
        landed += mine
        folder = tmp_path / "in" / str(no)
        folder.mkdir(parents=True)
        pq.write_table(spark.createDataFrame(mine, schema).toArrow(), folder / "events.parquet")
        for _ in range(2):                  # each run is a new query on the same checkpoint; the second finds nothing new
            ingest.dedup_stream(spark, str(tmp_path / "in" / "*"), schema, out)
            ingest.ingest_observations(spark, str(tmp_path / "in" / "*"), schema, obs)
        batch = ingest.obs_from_events(spark.createDataFrame(landed, schema))
        want = {(r.station, r.indicator, r.ts): (r.value, r.seq) for r in A.dedup_first(batch, ingest.KEYS).collect()}
        got = {(r.station, r.indicator, r.ts): (r.value, r.seq) for r in ingest.read_dedup(spark, out).collect()}
        assert got == want
        assert sorted(r.seq for r in spark.read.parquet(obs).collect()) == sorted(r.event_id for r in landed)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("jobs") / "obs.parquet")
    rows = [(s, i, hours(h), 20 + 3 * math.sin(h / 4) + h % 5 + len(s) + len(i), h) for h in range(400) for s in ("A", "Bb") for i in ("NO2", "PM10")]
    spark.createDataFrame(rows, "station string, indicator string, ts timestamp_ntz, value double, seq long").write.parquet(path)
    return path


def test_train_and_predict_jobs(spark, source, tmp_path):
    root, out = str(tmp_path / "models"), str(tmp_path / "forecast")
    first = train_job.run(spark, source, root)
    assert first.metrics["training_samples"] > 100 and math.isfinite(first.metrics["mae"])
    second = train_job.run(spark, source, root, hours=200)
    fc = predict_job.run(spark, source, root, out).collect()
    assert len(fc) == 6 * 4 and min(r["timestamp"] for r in fc) == hours(400)
    doc = sinks.read_forecast(spark, out)
    flat = {(r["station"], r["pollutant"], r["hour"]): r["value"] for r in M.flatten_forecast(doc).collect()}
    assert flat == {(r["station"], r["pollutant"], r["hour"]): r["value"] for r in fc}
    assert M.flatten_forecast(doc, "historical_data").count() == 24 * 4
    old = predict_job.run(spark, source, root, out, version=1).collect()
    assert first.run_id != second.run_id and [r["value"] for r in old] != [r["value"] for r in fc]


def test_jobs_name_what_is_missing(spark, source, tmp_path):
    root = str(tmp_path / "models")
    with pytest.raises(ValueError, match="need at least 40 hourly rows, found 20"):
        train_job.run(spark, source, root, hours=20)
    train_job.run(spark, source, root, hours=200)
    with pytest.raises(ValueError, match="need at least 24 hourly rows, found 10"):
        predict_job.run(spark, source, root, str(tmp_path / "f"), hours=10)
    with pytest.raises(FileNotFoundError):
        train_job.run(spark, str(tmp_path / "none.parquet"), root)
    empty = str(tmp_path / "empty.parquet")
    spark.read.parquet(source).limit(0).write.parquet(empty)
    with pytest.raises(ValueError, match="is empty"):
        predict_job.run(spark, empty, root, str(tmp_path / "f"))
