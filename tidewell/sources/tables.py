"""Readers for the input tables; the path is only ever handed to Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
