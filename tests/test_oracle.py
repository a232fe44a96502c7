"""Registered queries against their DuckDB twins on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tools.oracle_check import TABLES, digest

CHECKED = ["a1_dedup_first", "j10_densify", "w2_bfill", "a8_wide", "p10_lookback", "j1_merge_stations",
           "j9_assign_chunks", "u1_union_chunks", "a4_collect_by_station", "w3_ffill_table", "w4_lag_window",
           "w7_latest_per_station", "w9_dense_index", "m12_history", "m15_station_snapshot", "m1_build_samples",
           "a13_fit_scaler", "s5_decode_multipoint", "s10_decode_members", "f12_stride_positions",
           "t3_hourly_means", "m14_flatten_forecast", "a14_a15_persistence_metrics", "a16_m10_model_info_persistence",
           "s15_s16_forecast_json_persistence", "a10_compare_means_persistence", "m4_lasso_one_feature",
           "m4_lasso_optimality", "m8_resolve_model"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_matches_duckdb(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
