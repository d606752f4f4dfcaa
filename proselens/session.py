"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package where they see its folder; elsewhere it is installed or sent with --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in (paths := env.get("PYTHONPATH", "").split(":")):
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
