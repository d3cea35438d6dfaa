"""Parquet table source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan ``<root>/<name>.parquet``; filters and column lists reach the scan through Catalyst."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
