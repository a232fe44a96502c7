from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from aerogrid.session import get_session
    s = get_session("local[4]", 4)
    yield s


@pytest.fixture()
def pollution_wide(spark):
    """100 hourly rows from 2024-01-01 with three linear series (the
    reference's sample fixture), in long form."""
    rows = []
    start = dt.datetime(2024, 1, 1)
    for i in range(100):
        ts = start + dt.timedelta(hours=i)
        rows.append(("Helsinki Kallio 2", "Nitrogen dioxide", ts, 20.5 + 0.1 * i))
        rows.append(("Helsinki Kallio 2", "Particulate matter < 10 µm", ts, 25.0 + 0.2 * i))
        rows.append(("Helsinki Kallio 2", "Particulate matter < 2.5 µm", ts, 12.1 + 0.1 * i))
    return spark.createDataFrame(rows, "station string, indicator string, ts timestamp_ntz, value double")


SERIES3 = [("Helsinki Kallio 2", "Nitrogen dioxide"), ("Helsinki Kallio 2", "Particulate matter < 10 µm"),
           ("Helsinki Kallio 2", "Particulate matter < 2.5 µm")]
