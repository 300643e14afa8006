"""First, latest, last-n and top-n rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group. Spark drops rows beyond n in each input partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of each group that is last in ``order``. An aggregate, so a large group is combined before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__best")
    return df.groupBy(*by).agg(best).select(*by, *[F.col(f"__best.{c}").alias(c) for c in rest])


def seeded(key: str, seed: int) -> Column:
    """A pseudo-random order that reruns and other engines reproduce."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
