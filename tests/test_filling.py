"""The filled grid over landings equals the batch fill of all that landed."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from aerogrid.operators.aggregates import dedup_first
from aerogrid.operators.joins import densify
from aerogrid.operators.windows import fill_gaps
from aerogrid.streaming import filling

MONDAY = dt.datetime(2024, 1, 1)
SERIES = [("A", "x"), ("A", "y"), ("B", "x"), ("C", "never")]
SCHEMA = "station string, indicator string, ts timestamp_ntz, value double, units string, chunk_no long, seq long"


def _row(station, indicator, hour, value, seq, chunk=0):
    return (station, indicator, None if hour is None else MONDAY + dt.timedelta(hours=hour), value, "u", chunk, seq)


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _batch(spark, rows):
    obs = dedup_first(_frame(spark, rows).where("ts IS NOT NULL").drop("units"), ["station", "indicator", "ts"])
    return _sorted(fill_gaps(densify(obs, SERIES)))


def _sorted(df):
    return sorted(((r.station, r.indicator, r.ts, r.value, r.is_filled) for r in df.collect()), key=str)


def _stored(spark, root):
    return _sorted(filling.read_filled(spark, root))


def _weeks(*numbers):
    return [(MONDAY + dt.timedelta(weeks=n)).date() for n in numbers]


def test_late_value_refills_up_to_the_next_known_one(spark, tmp_path):
    root = str(tmp_path / "f")
    w = 168
    first = [_row("A", "x", 0, 1.0, 1), _row("A", "x", 4 * w, 5.0, 2), *[_row("A", "y", k * w + 3, 10.0 + k, 10 + k) for k in range(6)]]
    assert filling.land(_frame(spark, first), root, 0, SERIES) == _weeks(0, 1, 2, 3, 4, 5)
    assert _stored(spark, root) == _batch(spark, first)
    # late: A/x becomes known in week 1, so its gap in weeks 2 and 3 changes; week 4 starts with a gap of its own
    late = [_row("A", "x", w + 7, 2.0, 3)]
    again = filling.land(_frame(spark, late), root, 1, SERIES)
    assert set(_weeks(1, 2, 3)) <= set(again) and not set(_weeks(0, 5)) & set(again)
    assert _stored(spark, root) == _batch(spark, first + late)
    # a landing that changes no carried value fills its own week alone
    more = [_row("A", "y", 5 * w + 9, 99.0, 40)]
    assert filling.land(_frame(spark, more), root, 2, SERIES) == _weeks(5)
    assert _stored(spark, root) == _batch(spark, first + late + more)
    # an earlier copy of a stored row lands last: it counts
    better = [_row("A", "y", 3, -1.0, 0)]
    filling.land(_frame(spark, better), root, 3, SERIES)
    assert _stored(spark, root) == _batch(spark, first + late + more + better)


def test_repeated_empty_and_broken_landings(spark, tmp_path):
    root = str(tmp_path / "f")
    assert filling.read_filled(spark, root).count() == 0 and filling.vacuum(spark, root) == 0
    assert filling.land(_frame(spark, []), root, 0, SERIES) == []
    a = [_row("A", "x", 5, 1.0, 1), _row("A", "x", 5, 1.0, 1), _row("B", "x", None, 8.0, 2), _row("B", "x", 200, None, 3)]
    filling.land(_frame(spark, a), root, 1, SERIES)
    b = [_row("B", "x", 400, 4.0, 4)]
    filling.land(_frame(spark, [_row("B", "x", 30, 7.0, 9)]), root, 2, SERIES)      # a try that is repeated with other rows
    filling.land(_frame(spark, b), root, 2, SERIES)
    assert _stored(spark, root) == _batch(spark, a + b)
    filling.land(_frame(spark, []), root, 3, SERIES)
    assert _stored(spark, root) == _batch(spark, a + b)
    # a landing that stopped before its index is not seen, and does no harm to the next try
    keep = filling.newest(spark, root)
    real, filling._write = filling._write, None
    try:
        with pytest.raises(TypeError):
            filling.land(_frame(spark, [_row("A", "x", 6, 3.0, 5)]), root, 4, SERIES)
    finally:
        filling._write = real
    assert filling.newest(spark, root) == keep
    assert filling.vacuum(spark, root) > 0 and filling.vacuum(spark, root) == 0
    assert _stored(spark, root) == _batch(spark, a + b)


def test_random_landings(spark, tmp_path):
    rng = random.Random(7)
    root, rows = str(tmp_path / "f"), []
    for gen in range(4):
        part = [_row(*rng.choice(SERIES[:3]), rng.randrange(0, 1500, 5), rng.choice([None, float(rng.randrange(50))]), gen * 100 + i, rng.randrange(3))
                for i in range(25)]
        rows += part
        filling.land(_frame(spark, part), root, gen, SERIES)
        assert _stored(spark, root) == _batch(spark, rows)


def test_stream_over_restarts(spark, tmp_path):
    """Files landing between runs, the older days last, each run from the checkpoint."""
    from aerogrid.sources.testbed import load_obs, testbed_series
    from conftest import SF_SMALL

    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    half = events.selectExpr("percentile_approx(unix_micros(CAST(ts AS timestamp)), 0.5)").first()[0]
    folder, root = str(tmp_path / "in"), str(tmp_path / "f")
    newer = f"unix_micros(CAST(ts AS timestamp)) >= {half}"
    for n, rows in enumerate((newer, f"NOT ({newer})")):
        events.where(rows).coalesce(1).write.mode("append").parquet(folder)
        filling.fill_stream(spark, folder, events.schema, testbed_series(), root, max_files=1, name="*.parquet")
    obs = dedup_first(load_obs(spark, SF_SMALL).drop("units"), ["station", "indicator", "ts"])
    assert filling.newest(spark, root)[0] == 1
    assert _stored(spark, root) == _sorted(fill_gaps(densify(obs, testbed_series())))
