"""Vectors, tokens and trigrams as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` needs it in a lambda, which would else compute it anew
    for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Scalar product of two arrays of numbers, in double precision; arrays of different lengths give null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where the lengths differ or a vector has no length, null where one is null."""
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def tokens(text: Column) -> Column:
    """Lower-cased words between white space; none for an empty text."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def word_ngrams(words: Column, n: int) -> Column:
    """The distinct runs of n words, joined by blanks; none where there are fewer words. Words are as of ``tokens``, without
    white space. One pattern looks ahead at each word and then passes it, so a long text costs time in proportion to its length
    and no expression is worked out anew for each word."""
    run = rf"(?<!\S)(?=(\S++(?: \S++){{{n - 1}}}))\S++ ?"
    return F.array_distinct(F.regexp_extract_all(F.array_join(words, " "), F.lit(run), F.lit(1)))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded with two blanks before and one after, as trigram indexes do."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))
    return F.array_distinct(grams)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all, of two arrays of distinct values; 0 where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(shared / F.nullif(F.size(a) + F.size(b) - shared, F.lit(0)), F.lit(0.0))


def containment(part: Column, whole: Column) -> Column:
    """How much of ``part`` is in ``whole``; 0 for an empty part."""
    return F.coalesce(F.size(F.array_intersect(part, whole)) / F.nullif(F.size(part), F.lit(0)), F.lit(0.0))
