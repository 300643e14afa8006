"""The parts of annual and quarterly reports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text as T

#: Every heading's pattern begins with one of these.
_ANCHOR = re.compile(r"item|management|\[?reserved|part")
#: A page number and the next item, not far behind: an entry of a table of contents.
_ENTRY = re.compile(r"\d{1,3}\s+item\s*\d")
_AHEAD = 150


def _folded(text: str) -> str:
    """Lower-cased without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def positions(text: str, headings: dict[str, tuple[re.Pattern, ...]]) -> list[tuple[int, str]]:
    """(position from 0, section) of each section found, by position. One scan gives all places where a heading can begin;
    a pattern's matches don't overlap, and the first pattern with a match that is no entry of a table of contents wins."""
    low = _folded(text)
    anchors = [m.start() for m in _ANCHOR.finditer(low)]
    entry = {at: _ENTRY.search(low, at, at + _AHEAD) is not None for at in anchors}
    found = []
    for section, patterns in headings.items():
        for pattern in patterns:
            end, at = 0, None
            for anchor in anchors:
                if anchor >= end and (m := pattern.match(low, anchor)):
                    end = m.end()
                    if not entry[anchor]:
                        at = anchor
                        break
            if at is not None:
                found.append((at, section))
                break
    return sorted(found)


def find_sections(filings: DataFrame, key: str, text: str, quarterly: Column, least: int = 100) -> DataFrame:
    """(key, section, at, n_chars, body) of every section of every filing, one row a section of more than ``least``
    characters once cleaned: ``at`` is the heading's 1-based position, n_chars its length up to the next heading, body its
    cleaned text. Null and empty filings have none, a null ``quarterly`` counts as annual. One pass without a shuffle."""
    annual = {s: tuple(map(re.compile, p)) for s, p in T.SECTIONS.items()}
    quarter = {s: tuple(map(re.compile, p)) for s, p in T.QUARTERLY_SECTIONS.items()}
    plain = filings.select(F.col(key), F.col(text).cast("string").alias("__text"), F.coalesce(quarterly, F.lit(False)).alias("__quarterly"))
    schema = filings.select(key).schema.add("section", "string").add("at", "integer").add("n_chars", "integer").add("__raw", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (cell, by_quarter) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                whole = cell.as_py()
                starts = positions(whole, quarter if by_quarter else annual) if whole else []
                if starts:
                    ends = [at for at, _ in starts[1:]] + [len(whole)]
                    columns = [[s for _, s in starts], [at + 1 for at, _ in starts], [e - at for (at, _), e in zip(starts, ends, strict=True)], [whole[at:e].strip() for (at, _), e in zip(starts, ends, strict=True)]]
                    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(starts))), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], schema.names)

    found = plain.mapInArrow(run, schema).withColumn("body", T.section_clean(F.col("__raw"))).drop("__raw")
    return found.where(F.length("body") > least)
