"""Splitting long texts into overlapping chunks, and large chunks into children."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From coarse to fine: how a text falls into units, and what joins them again.
_LEVELS = ((re.compile(r"\n\s*\n"), "\n\n"), (re.compile(r"(?<=[.!?])\s+(?=[A-Z])"), " "), (re.compile(r"\s+"), " "))

#: So many characters of chunks go back to Spark at a time.
CHARS = 1_000_000


def _tail(text: str, overlap: int) -> str:
    """The end of a chunk that begins the next one, cut at a blank if one is in its first half."""
    if overlap <= 0:
        return ""
    end = text[-overlap:]
    blank = end.find(" ") if len(text) > overlap else -1
    return end[blank + 1 :] if 0 < blank < len(end) // 2 else end


def split_text(text: str, size: int, overlap: int, least: int, level: int = 0) -> Iterator[str]:
    """Chunks of at most ``size`` characters where units allow. A unit that is too long is split by the next finer level;
    the last chunk of a level is dropped if it has fewer than ``least`` characters."""
    if level == 0 and len(text) <= size:
        if text.strip():
            yield text.strip()
        return
    cut, joint = _LEVELS[level]
    held = ""
    for unit in (u.strip() for u in cut.split(text)):
        if not unit:
            continue
        if len(unit) > size and level + 1 < len(_LEVELS):
            if held:
                yield held.strip()
                held = ""
            yield from split_text(unit, size, overlap, least, level + 1)
        elif held and len(held) + len(joint) + len(unit) > size:
            yield held.strip()
            begin = _tail(held, overlap)
            held = begin + joint + unit if begin else unit
        else:
            held = held + joint + unit if held else unit
    if len(held.strip()) >= least and held:
        yield held.strip()


def _in_pieces(batches: Iterator[pa.RecordBatch], kept: int, kinds: tuple, names: list[str], cut: Callable[..., Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
    """The rows that ``cut`` makes of each text and its prefix, which follow the first ``kept`` columns, a batch whenever there
    are ``CHARS`` characters of chunks. No more than one text and one such batch are held beside what Arrow brought."""
    for batch in batches:
        rows: list[tuple] = []
        chars = 0

        def flushed(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
            own, *rest = zip(*rows, strict=True)
            take = pa.array(own, pa.int64())
            return pa.RecordBatch.from_arrays([*[c.take(take) for c in batch.columns[:kept]], *[pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]], names)

        prefixes = batch.column(kept + 1) if batch.num_columns > kept + 1 else [None] * batch.num_rows
        for i, (cell, prefix) in enumerate(zip(batch.column(kept), prefixes, strict=True)):
            for row in cut(cell, prefix):
                rows.append((i, *row))
                chars += len(row[1])
                if chars >= CHARS:
                    yield flushed()
                    rows, chars = [], 0
        if rows:
            yield flushed()


def chunk(df: DataFrame, key: str, text: str, size: int = 4000, overlap: int = 800, least: int = 200) -> DataFrame:
    """(key, chunk_no int, chunk string) of every text; null and blank texts have none. Texts are independent of each other,
    so this is one pass without a shuffle."""
    plain = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    schema = df.select(key).schema.add("chunk_no", "integer").add("chunk", "string")

    def cut(cell: pa.StringScalar, _: None) -> Iterator[tuple]:
        yield from enumerate(split_text(cell.as_py() or "", size, overlap, least))

    kinds = (pa.int32(), pa.string())
    return plain.mapInArrow(lambda batches: _in_pieces(batches, 1, kinds, schema.names, cut), schema)


def sections(df: DataFrame, key: str, section: str, text: str, prefix: Column | None = None, size: int = 4000, overlap: int = 800, least: int = 200) -> DataFrame:
    """Chunks of sections of filings: chunk_id (key_section_number), key, section, chunk_no, chunk, char_start, char_end and
    n_chunks. With ``prefix``, a text column that goes before each chunk, there is that much less room, but at least twice
    ``least``. Positions are those of the chunk's beginning in the text, looked for from the end of the one before less the
    overlap, and found by its first 100 characters. Sections shorter than ``least`` have no chunks.
    """
    plain = df.select(F.col(key), F.col(section), F.col(text).cast("string").alias("__text"), (F.lit("") if prefix is None else F.coalesce(prefix, F.lit(""))).alias("__prefix"))
    schema = df.select(key, section).schema.add("chunk_no", "integer").add("chunk", "string").add("char_start", "integer").add("char_end", "integer").add("n_chunks", "integer")

    def cut(cell: pa.StringScalar, prefix: pa.StringScalar) -> Iterator[tuple]:
        value, head = cell.as_py(), prefix.as_py()
        if value is None or len(value) < least:
            return
        room = max(size - len(head), 2 * least) if head else size
        parts, begin = list(split_text(value, room, overlap, least)), 0
        for n, part in enumerate(parts):
            at = value.find(part[:100], begin)
            at = begin if at < 0 else at
            yield n, head + part, at, at + len(part), len(parts)
            begin = max(begin, at + len(part) - overlap)

    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
    rows = plain.mapInArrow(lambda batches: _in_pieces(batches, 2, kinds, schema.names, cut), schema)
    return rows.select(F.concat_ws("_", F.col(key).cast("string"), F.col(section), F.col("chunk_no").cast("string")).alias("chunk_id"), *schema.names)


def hierarchy(df: DataFrame, key: str, text: str, parent: tuple[int, int, int] = (4000, 0, 200), child: tuple[int, int, int] = (512, 64, 50)) -> DataFrame:
    """Parents (level 0) and their children (level 1): id, parent_id, level, chunk. Ids are key_n and key_n_m."""
    big = chunk(df, key, text, *parent).withColumn("id", F.concat_ws("_", F.col(key).cast("string"), F.col("chunk_no").cast("string")))
    small = chunk(big.select("id", "chunk"), "id", "chunk", *child)
    return big.select("id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"), "chunk").union(
        small.select(F.concat_ws("_", F.col("id"), F.col("chunk_no").cast("string")), F.col("id"), F.lit(1), F.col("chunk"))
    )
