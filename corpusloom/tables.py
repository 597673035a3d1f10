"""Access to the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; the path may be on any store that Spark's readers know."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
