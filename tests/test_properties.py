"""Property checks (hypothesis): fill idempotence, grid size, sample count."""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from aerogrid.operators.joins import densify
from aerogrid.operators.windows import fill_gaps
from aerogrid.plans.samples import build_samples

T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

values = st.lists(st.one_of(st.none(), st.floats(-100, 100, allow_nan=False)), min_size=1, max_size=60)


def _frame(spark, vals, station="A", ind="x", step=H):
    rows = [(station, ind, T0 + i * step, v) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "station string, indicator string, ts timestamp_ntz, value double")


def _pandas_fill(vals):
    out, last = [], None
    for v in vals:
        last = v if v is not None else last
        out.append(last)
    nxt = None
    for i in range(len(out) - 1, -1, -1):
        nxt = out[i] if out[i] is not None else nxt
        out[i] = out[i] if out[i] is not None else nxt
    return out


@SETTINGS
@given(vals=values)
def test_fill_matches_sequential_and_is_idempotent(spark, vals):
    # 10-hour steps so a short list still crosses several week blocks
    df = _frame(spark, vals, step=10 * H)
    once = fill_gaps(df).drop("is_filled")
    got = [r.value for r in once.orderBy("ts").collect()]
    assert got == _pandas_fill(vals)
    twice = [r.value for r in fill_gaps(once).orderBy("ts").collect()]
    assert twice == got


@SETTINGS
@given(a=st.sets(st.integers(0, 40), min_size=1, max_size=20), b=st.sets(st.integers(0, 40), min_size=1, max_size=20))
def test_dense_grid_size(spark, a, b):
    rows = [("A", "x", T0 + i * H, float(i)) for i in a] + [("B", "x", T0 + i * H, float(i)) for i in b]
    df = spark.createDataFrame(rows, "station string, indicator string, ts timestamp_ntz, value double")
    g = densify(df, [("A", "x"), ("B", "x")])
    assert g.count() == len(a | b) * 2
    assert g.where("value IS NOT NULL").count() == len(a) + len(b)


@SETTINGS
@given(n_rows=st.integers(1, 80), T=st.integers(1, 12), n=st.integers(1, 6))
def test_sample_count(spark, n_rows, T, n):
    df = _frame(spark, [float(i) for i in range(n_rows)])
    s = build_samples(df, [("A", "x")], T=T, n=n, block_rows=16)
    assert s.count() == max(0, n_rows - T - n + 1)
