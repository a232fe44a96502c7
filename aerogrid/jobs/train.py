"""Train job: ``spark-submit aerogrid/jobs/train.py --input OBS.parquet --models ROOT``.

Reads the last weeks of observations, checks that there are enough rows,
fits the model, stores it as the next version and prints its metrics.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.errors import AnalysisException  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from aerogrid import constants as K  # noqa: E402
from aerogrid.jobs.common import filled_grid, observations, series_of  # noqa: E402
from aerogrid.operators.project import require_rows  # noqa: E402
from aerogrid.plans import model as M  # noqa: E402
from aerogrid.plans import registry as R  # noqa: E402
from aerogrid.session import get_session  # noqa: E402


def next_version(spark: SparkSession, root: str) -> int:
    try:
        return (R.read(spark, root, "model_versions").agg(F.max("version")).first()[0] or 0) + 1
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 1


def run(spark: SparkSession, source: str, root: str, hours: int = K.CHUNK_HOURS * K.TRAIN_CHUNKS, T: int = K.TRAINING_HOURS,
        n: int = K.N_STEPS, alpha: float = K.LASSO_ALPHA, stage: str = K.STAGE_PRODUCTION) -> M.Model:
    """Train on the last ``hours`` hours at ``source`` and register the model under ``root``."""
    obs = observations(spark, source, hours)
    series = series_of(obs)
    filled = filled_grid(obs, series)
    require_rows(filled.select("ts").distinct(), T + n + K.TRAIN_EXTRA_ROWS, "hourly rows")
    model = M.train(spark, filled, series, T, n, alpha)
    now = int(dt.datetime.now(dt.timezone.utc).timestamp() * 1000)
    R.save_model(spark, model, root, next_version(spark, root), stage, created_ms=now)
    return model


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--models", required=True)
    p.add_argument("--hours", type=int, default=K.CHUNK_HOURS * K.TRAIN_CHUNKS)
    a = p.parse_args(args)
    model = run(get_session(), a.input, a.models, a.hours)
    print(json.dumps({"run_id": model.run_id, **model.metrics}))


if __name__ == "__main__":
    main()
