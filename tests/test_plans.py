"""Plan-shape checks: the properties the scale design relies on, read from
the physical plans (the initial adaptive plan; AQE may only improve it)."""

from __future__ import annotations

import contextlib
import io
import re

from aerogrid.operators import project as P
from aerogrid.operators.aggregates import dedup_first
from aerogrid.operators.joins import densify
from aerogrid.operators.windows import fill_gaps, tail_per_key, window_arrays
from aerogrid.plans.catalog_core import deduped, recent_obs
from aerogrid.plans.model import latest_rows
from aerogrid.session import cut_lineage
from aerogrid.sources import testbed as TB
from aerogrid.sources.tables import table
from conftest import SERIES3, SF_SMALL

KEYS = ["station", "indicator", "ts"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    """``explain("formatted")`` text: node details are not truncated."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def exchanges(text: str) -> list[tuple[str, str]]:
    """(exchange line, the line of its child operator)."""
    lines = text.splitlines()
    return [(ln, lines[i + 1] if i + 1 < len(lines) else "")
            for i, ln in enumerate(lines) if "Exchange hashpartitioning" in ln]


def test_dedup_aggregates_before_the_shuffle(spark):
    text = plan(dedup_first(TB.load_obs(spark, SF_SMALL), KEYS))
    ex = text.index("Exchange hashpartitioning(station")
    assert "partial_min_by" in text[ex:], "no partial aggregate below the exchange"


def test_dedup_of_fixed_width_columns_does_not_sort(spark):
    text = plan(deduped(spark, SF_SMALL))
    assert "HashAggregate" in text and "SortAggregate" not in text and "Sort " not in text


def test_prediction_window_bounds_the_scan(spark):
    text = formatted(recent_obs(spark, SF_SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", text)


def test_fill_never_shuffles_rows_by_series_alone(spark):
    dense = cut_lineage(densify(dedup_first(TB.load_obs(spark, SF_SMALL), KEYS), TB.testbed_series()))
    text = plan(fill_gaps(dense))
    exs = exchanges(text)
    assert any("_blk" in ln for ln, _ in exs), "row windows are not blocked in time"
    for ln, child in exs:
        if "_blk" not in ln:
            # only the per-(series, block) summary is partitioned by series
            assert "Aggregate" in child, ln
    # the summary is a hash aggregate (single fixed-width order column)
    assert "partial_max_by" in text and "HashAggregate" in text


def test_time_range_reaches_the_scan_with_pruned_columns(spark):
    li = table(spark, SF_SMALL, "lineitem")
    df = P.time_range(li, "1996-01-01 00:00:00", "1997-12-31 00:00:00", "l_shipdate").select(
        "l_orderkey", "l_shipdate")
    text = formatted(df)
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text).group(1)
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThanOrEqual(l_shipdate" in pushed
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", text).group(1)
    assert "l_comment" not in schema and "l_quantity" not in schema


def test_forecast_reads_only_the_tail(spark, pollution_wide):
    landed = cut_lineage(pollution_wide)
    text = formatted(latest_rows(landed, SERIES3, 24))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text).group(1)
    assert "GreaterThanOrEqual(ts" in pushed


def test_tail_per_key_limits_before_the_shuffle(spark):
    text = plan(tail_per_key(TB.load_obs(spark, SF_SMALL), ["station", "indicator"], "ts", 24))
    ex = text.index("Exchange hashpartitioning(station")
    assert "WindowGroupLimit" in text[ex:] and "Partial" in text[ex:], "no map-side group limit"


def test_lag_windows_partition_by_block(spark, pollution_wide):
    rows = pollution_wide.selectExpr("station", "indicator", "ts", "value",
                                     "CAST(unix_seconds(CAST(ts AS TIMESTAMP)) / 3600 AS BIGINT) AS idx")
    text = plan(window_arrays(rows, ["station", "indicator"], "idx", ["value"], before=24, after=6))
    assert any("_tblk" in ln for ln, _ in exchanges(text))


def test_no_query_plans_a_cross_product_or_an_unbounded_single_partition(spark):
    """No registered query plans a Cartesian product or nested-loop join, and
    every single-partition exchange sits on an aggregate (a global partial
    aggregate, or one row per day / hour block), never on raw rows."""
    import __spark_entry__ as E
    bad = []
    for name, fn in E.queries().items():
        text = plan(fn(spark, SF_SMALL))
        bad += [(name, p) for p in ("CartesianProduct", "BroadcastNestedLoopJoin") if p in text]
        lines = text.splitlines()
        for i, ln in enumerate(lines):
            if "Exchange SinglePartition" in ln and "Aggregate" not in (lines[i + 1] if i + 1 < len(lines) else ""):
                bad.append((name, ln.strip()[:120]))
    assert not bad
