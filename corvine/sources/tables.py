"""Reading the corpus tables from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table, ``<root>/<name>.parquet`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def rows_once(df: DataFrame, key: str = "id") -> DataFrame:
    """Repeated deliveries of a row count once: one row for each non-null key."""
    return df.filter(df[key].isNotNull()).dropDuplicates([key])
