"""Predict job: ``spark-submit aerogrid/jobs/predict.py --input OBS.parquet --models ROOT --output PATH``.

Loads the registered model, reads the last hours of observations, and writes
the forecast document.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from aerogrid import constants as K  # noqa: E402
from aerogrid.jobs.common import filled_grid, observations  # noqa: E402
from aerogrid.plans import model as M  # noqa: E402
from aerogrid.plans import registry as R  # noqa: E402
from aerogrid.session import get_session  # noqa: E402
from aerogrid.sources import sinks  # noqa: E402


def run(spark: SparkSession, source: str, root: str, out: str, hours: int = K.PREDICT_WINDOW_HOURS, version: int | None = None) -> DataFrame:
    """Forecast from the last ``hours`` hours at ``source`` by the model under
    ``root`` (the served version by default) and write the document to ``out``.
    Too few rows raise, with the number needed and found."""
    model = R.load_registered(spark, root, version=version)
    filled = filled_grid(observations(spark, source, hours), model.series)
    forecast = M.forecast(spark, filled, model, strict=True)
    at = filled.agg(F.max("ts")).first()[0]
    sinks.write_forecast(M.forecast_document(forecast, M.history(filled, model.series, model.T), at), out)
    return forecast


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    for name in ("--input", "--models", "--output"):
        p.add_argument(name, required=True)
    p.add_argument("--hours", type=int, default=K.PREDICT_WINDOW_HOURS)
    p.add_argument("--version", type=int)
    a = p.parse_args(args)
    run(get_session(), a.input, a.models, a.output, a.hours, a.version)


if __name__ == "__main__":
    main()
