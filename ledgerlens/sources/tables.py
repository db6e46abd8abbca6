"""Table scans by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
