"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a dataset folder; columns and filters are pruned into the scan by the planner."""
    return spark.read.parquet(f"{base}/{name}.parquet")
