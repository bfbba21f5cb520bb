"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is not installed: its parent folder joins their path."""
    env = spark.sparkContext.environment
    home = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if home not in paths:
        env["PYTHONPATH"] = ":".join([home, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
