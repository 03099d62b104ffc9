"""Readers of the columnar tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of a directory that holds one Parquet dataset per table."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
