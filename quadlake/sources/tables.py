"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as it lies. Its tasks follow from the size of its files and
    spark.sql.files.maxPartitionBytes alone, so a plan is the same at any size."""
    return spark.read.parquet(f"{folder}/{name}.parquet")

