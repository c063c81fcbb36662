"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one table of a data directory; filters and projections reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
