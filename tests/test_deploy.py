"""Deployment contract: the driver's own session, another working folder and
another process time zone.  Python workers must still import the package
(shipped with addPyFile), and the entry points must apply the engine's
session settings."""

from __future__ import annotations

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent(f"""
    import importlib.util
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "America/New_York").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(ROOT, "__spark_entry__.py")!r})
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    rows = mod.queries()["m4_fit_lasso"](spark, "/root/testdata/sf0.001").count()
    print("ROWS", rows, spark.conf.get("spark.sql.session.timeZone"))
""")


def test_entry_from_another_folder_and_zone(tmp_path):
    env = dict(os.environ, TZ="America/New_York")
    env.pop("PYTHONPATH", None)
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("ROWS")][0]
    _, n, zone = line.split()
    assert int(n) == 90 * 364 and zone == "UTC"
