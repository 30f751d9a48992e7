"""Sinks: append, whole rewrite, seed rows, reset. Parquet folders, no table format assumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.state import insert_ignore


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def rewrite(df: DataFrame, path: str) -> None:
    """Replace a folder's rows. df must not read from path."""
    df.write.mode("overwrite").parquet(path)


def seed(spark: SparkSession, rows: list[tuple], schema: str, existing: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """existing and those seed rows whose key it doesn't have."""
    return existing.unionByName(insert_ignore(existing, spark.createDataFrame(rows, schema), keys, order))


def reset(df: DataFrame, path: str) -> None:
    """Keep the schema, drop the rows."""
    rewrite(df.where("false"), path)
