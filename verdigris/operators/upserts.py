"""Merging new rows into a table that has a key: what the new rows are, and stored tables of which only the touched parts are
written anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources.shared import written

_PART = "__part"


def upsert(target: DataFrame, new: DataFrame, key: str, keep_old_when_null: list[str] | None = None) -> DataFrame:
    """New rows replace old ones of the same key and are added where there is none. For the columns named, a null in a new
    row keeps the old value. Keys are unique on either side."""
    kept = set(keep_old_when_null or [])
    joined = target.alias("t").join(new.alias("n"), F.col(f"t.{key}") == F.col(f"n.{key}"), "full_outer")
    given = F.col(f"n.{key}").isNotNull()
    pick = lambda c: F.coalesce(f"n.{c}", f"t.{c}") if c in kept or c == key else F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"t.{c}"))
    return joined.select(*[pick(c).alias(c) for c in target.columns])


def insert_ignore(target: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows to append: those of new whose key the target doesn't have, one a key."""
    return new.dropDuplicates(key).join(target.select(*key), key, "left_anti").select(*target.columns)


def delta(target: DataFrame, new: DataFrame, key: str, status: str, retired: str) -> DataFrame:
    """What each new row does: retire (its status is ``retired``), update (the target has its key) or insert."""
    known = target.select(F.col(key).alias("__k"))
    joined = new.join(known, F.col(key) == F.col("__k"), "left")
    action = F.when(F.col(status) == retired, F.when(F.col("__k").isNull(), "skip").otherwise("retire")).when(F.col("__k").isNotNull(), "update").otherwise("insert")
    return joined.withColumn("action", action).drop("__k")


def delete(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows that stay; rows with a null key stay."""
    return target.join(keys.select(key).distinct(), key, "left_anti").select(*target.columns)


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias(_PART)


def store(table: DataFrame, path: str, key: str, parts: int) -> None:
    """Write a table in ``parts`` folders by a hash of its key, so that later merges touch few of them."""
    table.select("*", _part(key, parts)).repartition(parts, _PART).write.partitionBy(_PART).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(_PART)


def merge_into(spark: SparkSession, path: str, new: DataFrame, key: str, parts: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Merge ``new`` into the table that ``store`` has written to ``path``. merge: (old rows, new rows) -> rows, which must
    keep a row's key and columns.

    Only folders that a new key falls into are read, merged, staged in another folder, and then overwritten; the others'
    files aren't touched. A run that fails before the last step leaves the table as it was; the last step may be repeated,
    since it reads the staging folder alone. A merge that leaves no row in a folder leaves this folder as it was: retire
    rows by a status instead, as ``delta`` does."""
    new = written(new.select("*", _part(key, parts)), "new-rows")
    touched = [r[0] for r in new.select(_PART).distinct().collect()]  # at most ``parts``
    old = spark.read.parquet(path).where(F.col(_PART).isin(touched)).drop(_PART)
    merged = written(merge(old, new.drop(_PART)).select("*", _part(key, parts)), "staged")
    merged.repartition(parts, _PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(path)
