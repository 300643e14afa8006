"""Predicates built from optional arguments, and JSON and array tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_all(df: DataFrame, predicates: list[Column | None]) -> DataFrame:
    """Keep rows for which every given predicate holds; a None is no condition."""
    given = [p for p in predicates if p is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def equals(name: str, value: object | None) -> Column | None:
    return None if value is None else F.col(name) == F.lit(value)


def between(name: str, low: object | None, high: object | None) -> list[Column | None]:
    return [None if low is None else F.col(name) >= F.lit(low), None if high is None else F.col(name) <= F.lit(high)]


def overlaps(name: str, values: list[str] | None) -> Column | None:
    """Any of the values is in the array; no values is no condition."""
    return F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in values])) if values else None


def json_equals(name: str, key: str, value: str) -> Column:
    """The JSON object's key holds this value as text; text that is no JSON doesn't match."""
    return F.get_json_object(name, f"$.{key}") == value


def json_has(name: str, key: str) -> Column:
    """The JSON object has the key, be its value null."""
    return F.array_contains(F.json_object_keys(name), key)


def by_ids(df: DataFrame, name: str, ids: list[str]) -> DataFrame:
    """Rows with one of the ids, given as text; ids that aren't whole numbers are skipped, as unknown ids are."""
    wanted = [int(i) for i in ids if i.lstrip("-").isdigit()]
    return df.where(F.col(name).isin(wanted)) if wanted else df.where(F.lit(False))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of an order that ends in a unique key. With a limit Spark keeps only the first rows of each partition."""
    return df.orderBy(*order).offset(offset).limit(limit)
