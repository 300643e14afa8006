"""Ranking metrics over arrays of expected and retrieved ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hits(expected: Column, top: Column) -> Column:
    return F.size(F.filter(top, lambda x: F.array_contains(expected, x)))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def recall_at_k(expected: Column, retrieved: Column, k: int) -> Column:
    """Distinct expected ids among the first k, over the length of the expected list, duplicates included."""
    return _ratio(F.size(F.array_intersect(expected, F.slice(retrieved, 1, k))), F.size(expected))


def precision_at_k(expected: Column, retrieved: Column, k: int) -> Column:
    """Positions among the first k that hold an expected id, over how many of the k there are."""
    top = F.slice(retrieved, 1, k)
    return _ratio(_hits(expected, top), F.size(top))


def mrr(expected: Column, retrieved: Column) -> Column:
    """One over the rank of the first hit in the whole list; 0 without one."""
    ranks = F.transform(retrieved, lambda x, i: F.when(F.array_contains(expected, x), i + 1))
    return F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0))


def hit_rate(expected: Column, retrieved: Column) -> Column:
    return F.arrays_overlap(expected, retrieved).cast("double")


def found_recall(hits: Column, n_expected: Column, k: int) -> Column:
    """As recall_at_k, from whether each rank is a hit and how many items were expected."""
    return _ratio(F.size(F.filter(F.slice(hits, 1, k), lambda h: h)), n_expected)


def found_precision(hits: Column, k: int) -> Column:
    return _ratio(F.size(F.filter(F.slice(hits, 1, k), lambda h: h)), F.least(F.size(hits), F.lit(k)))


def found_mrr(hits: Column) -> Column:
    return F.coalesce(1.0 / F.nullif(F.array_position(hits, True), F.lit(0)), F.lit(0.0))


def found_ndcg(hits: Column, n_expected: Column, k: int) -> Column:
    best = F.least(n_expected.cast("int"), F.lit(k))
    gain = lambda flags: F.aggregate(F.transform(flags, lambda h, i: F.when(h, 1.0 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda s, g: s + g)
    return _ratio(gain(F.slice(hits, 1, k)), gain(F.array_repeat(F.lit(True), F.greatest(best, F.lit(0)))))


def ndcg_at_k(expected: Column, retrieved: Column, k: int) -> Column:
    """Binary gains, discount log2(rank + 1); the ideal has the distinct expected ids first. Repeated hits each count."""
    gains = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(expected, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    best = F.least(F.size(F.array_distinct(expected)), F.lit(k))
    ideal = F.when(best > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(best, F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))).otherwise(0.0)
    return _ratio(F.aggregate(gains, F.lit(0.0), lambda s, g: s + g), ideal)
