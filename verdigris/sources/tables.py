"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The same rows dealt out by a key. A file is read by as many tasks as it has row groups, often one of a million rows, so
    that costly work on its rows would else be left to few cores."""
    return df.repartition(key)
