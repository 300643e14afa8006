"""Runs in word sequences: maximal stretches with a small period that go round four times or more.

A run of smallest period q, 2**k <= q < 2**(k+1), holds a whole aligned block of 2**k words among the first of its
periods, and the block again q words further on. So for each scale the aligned blocks that could be part of a run are the
keys of an Aho-Corasick automaton over word numbers, the stretches behind them are searched for further occurrences, and
each occurrence 2**k to 2**(k+1) - 1 words behind its block is a seed, which is extended word by word in both directions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text split into words at once.
PART_BYTES = 4 << 20
_SPACES = b" \t\n\x0b\x0c\r"

#: Word numbers after a change to the sequence: (id of the document, word numbers) -> word numbers.
Change = Callable[[int | None, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class RunRule:
    """Which stretches are runs: ``least_turns`` periods or more and ``least_words`` words or more. Seeds need four turns."""

    least_turns: int = 4
    least_words: int = 6

    def __post_init__(self) -> None:
        if self.least_turns < 4:
            raise ValueError("a block and its repetition are sure to lie in a run of four periods or more only")


def parts(text: bytes, limit: int = PART_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, some ``limit`` bytes at a time; cuts are made at spaces only."""
    at = 0
    while at < len(text):
        to = min(at + limit, len(text))
        while to < len(text) and text[to] not in _SPACES:
            to += 1
        yield text[at:to].split()
        at = to


def number(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers in order of first appearance, and the distinct words."""
    known: dict[bytes, int] = {}
    found = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in parts(text)]
    return np.concatenate(found) if found else np.zeros(0, np.int64), list(known)


def _gaps(ids: np.ndarray) -> np.ndarray:
    """How far on each word stands next; 2n where it doesn't."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    gaps = np.full(n, 2 * n, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gaps[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gaps


def _agree(ids: np.ndarray, at: int, step: int, distance: int) -> int:
    """How many words from ``at`` on, going by ``step``, equal the word ``distance`` further on in the text."""
    room = len(ids) - distance - at if step > 0 else at + 1
    done, size = 0, 32
    while done < room:
        size = min(2 * size, room - done)
        if step > 0:
            lo = at + done
            differ = ids[lo : lo + size] != ids[lo + distance : lo + distance + size]
        else:
            hi = at - done + 1
            differ = (ids[hi - size : hi] != ids[hi - size + distance : hi + distance])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done += size
    return done


def _seeds(ids: np.ndarray, blocks: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(start of a block, distance) of every occurrence of one of ``blocks`` size to 2 size - 1 words behind it."""
    starts = blocks * size
    keys = list(map(tuple, ids[starts[:, None] + np.arange(size)].tolist()))
    of_key = {key: i for i, key in enumerate(dict.fromkeys(keys))}
    of_block = dict(zip(blocks.tolist(), map(of_key.__getitem__, keys), strict=True))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, i in of_key.items():
        automaton.add_word(key, i)
    automaton.make_automaton()
    new = np.flatnonzero(np.diff(starts, prepend=-4 * size) > 2 * size)  # the searched stretches of other blocks don't meet it
    ends = np.append(starts[new[1:] - 1], starts[-1]) + 3 * size - 1
    for lo, hi in zip((starts[new] + size).tolist(), np.minimum(ends, len(ids)).tolist(), strict=True):
        for end, key in automaton.iter(tuple(ids[lo:hi].tolist())):
            found = lo + end - size + 1
            block = found // size - 1
            if of_block.get(block) == key:
                yield block * size, found - block * size


def find_runs(ids: np.ndarray, rule: RunRule = RunRule()) -> list[tuple[int, int, int]]:
    """All runs of a sequence of numbers as (start, length, smallest period), by start, then period."""
    n = len(ids)
    if n < 4:
        return []
    gaps = _gaps(ids)
    found: dict[tuple[int, int], int] = {}
    size = 1
    while 4 * size <= n:
        # Every word of a block within a run stands again one period later.
        near = gaps[: n // size * size].reshape(-1, size).max(axis=1) < 2 * size
        blocks = np.flatnonzero(near)
        if len(blocks) and found:
            # Where a smaller period covers a block and all that may follow it, no larger one is smallest.
            cover = np.zeros(n, np.int64)
            for start, end in found:
                cover[start] = max(cover[start], end)
            blocks = blocks[np.maximum.accumulate(cover)[blocks * size] < np.minimum((blocks + 3) * size, n)]
        if len(blocks):
            known = dict(found)
            seen: dict[int, int] = {}  # by distance, where the last extended stretch ends
            for at, distance in _seeds(ids, blocks, size):
                if seen.get(distance, -1) >= at + size:
                    continue
                start = at - _agree(ids, at - 1, -1, distance)
                end = at + size + _agree(ids, at + size, 1, distance)
                seen[distance] = end
                if end - start >= 3 * distance and (start, end + distance) not in known:
                    span = (start, end + distance)
                    found[span] = min(distance, found.get(span, distance))
        size *= 2
    runs = [(lo, hi - lo, q) for (lo, hi), q in found.items() if hi - lo >= max(rule.least_words, rule.least_turns * q)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


RUNS_SCHEMA = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: RunRule = RunRule(), change: Change | None = None) -> DataFrame:
    """The runs of every document, and its words without the turns after the first.

    Words are ``[^\\x20\\x09-\\x0D]+``, of whole texts, compared byte by byte. A run is a maximal stretch with smallest
    period q of at least ``rule``'s length; a word is dropped if it stands in a run after its first q words.
    change: applied to a document's word numbers (in order of first appearance) before the search.
    Returns (id, n_words, runs by start then period, collapsed: the words kept, UTF-8, joined by a space), one row for each
    row of docs. A null or empty text has no words and no runs. Ids may be null or repeated; other columns are ignored.
    Memory is a few dozen bytes a word of the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                counts, spans, texts = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids, words = number(text.as_py() or b"")
                    if change is not None:
                        ids = change(doc, ids)
                    runs = find_runs(ids, rule)
                    kept = ids[_kept(len(ids), runs)] if runs else ids
                    counts.append(len(ids))
                    spans.append([{"start": s, "length": length, "period": q} for s, length, q in runs])
                    texts.append(b" ".join(map(words.__getitem__, kept.tolist())))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.binary())], ["id", "n_words", "runs", "collapsed"])

    return docs.selectExpr(f"cast(`{id_col}` as long) AS id", f"cast(cast(`{text_col}` as string) as binary) AS text").mapInArrow(run, RUNS_SCHEMA)
