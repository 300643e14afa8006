"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Line features come from one vectorised pass over a slice of documents. The field has two states; Viterbi decoding gives
the best labelling of a document's lines, and the share of words in content lines decides whether a document stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import scratch
from verdigris.llm import words as W


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL = _table("#*$%&|<>")
_DIGIT = _table("0123456789")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER[128:] = True
_SHOUT = _table("!?")
_STOP = _table(".!?:;\"')")
FEATURES = (
    "bias", "1-2 words", "3-7 words", "8-19 words", "20 words or more", "some symbols", "many symbols", "mostly symbols after words", "digits", "many digits", "upper case",
    "exclamations", "ends a sentence", "seen before", "stutters", "stutters much", "long words", "short words", "first line", "last line", "few letters",
)


@dataclass(frozen=True)
class Fit:
    """sample_rows and sample_lines bound the labelled documents that the field is fitted on, chosen by a hash of their id, and
    their lines; their line features are collected. A line that follows ``contexts`` different lines or more over all
    documents is boilerplate wherever it stands. shrink is the ridge on all weights."""

    sample_rows: int = 3000
    sample_lines: int = 200_000
    contexts: int = 4
    shrink: float = 2.0
    steps: int = 120


@dataclass(frozen=True)
class Field:
    emission: np.ndarray  # [feature, state]; state 1 is content
    transition: np.ndarray  # [from, to]


@dataclass
class Measured:
    """A slice's base counts by document, and its lines in order."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    bounds: np.ndarray  # lines of each document
    features: np.ndarray  # [line, feature], 0 or 1
    line_words: np.ndarray
    line_hashes: np.ndarray


def _repeats(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more in its row, and whether it occurred before."""
    order = np.lexsort((np.arange(len(key)), key, row))
    k, r = key[order], row[order]
    same = np.zeros(len(k), dtype=bool)
    same[1:] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    often = same.copy()
    often[:-1] |= same[1:]
    out_often, out_before = np.empty(len(key), bool), np.empty(len(key), bool)
    out_often[order], out_before[order] = often, same
    return out_often, out_before


def measure(part: W.Slice) -> Measured:
    data = part.data
    words = W.words(part)
    hasher = W.SpanHasher(data)
    h = hasher(words.start, words.end)
    begins = (data & 0xC0) != 0x80
    three, at = W.windows(h, words.bounds, 3)
    sizes = np.diff(at)
    row3 = np.repeat(np.arange(part.rows), sizes)
    often, _ = _repeats(three, row3)
    first = (np.repeat(words.bounds[:-1], sizes) + np.arange(at[-1]) - np.repeat(at[:-1], sizes))[often]
    covered = np.zeros(len(h), dtype=bool)
    for i in range(3):
        covered[first + i] = True

    lines = W.spans(data != 0x0A, part.bounds)
    of = np.searchsorted(lines.start, words.start, side="right") - 1
    n_words = np.bincount(of, minlength=len(lines.start))
    real = n_words > 0
    start, end, row, n = lines.start[real], lines.end[real], lines.row[real], n_words[real]
    line_hash = hasher(start, end)
    _, before = _repeats(line_hash, row)

    def share(mask: np.ndarray, of_what: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (total[end] - total[start]) / of_what

    stutter = np.zeros(len(h), dtype=bool)
    stutter[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    again = np.bincount(of, weights=stutter, minlength=len(real))[real] / n
    solid = np.maximum(share(~W._SPACE[data], 1), 1)
    symbols, letters = share(_SYMBOL[data], solid), share(_LETTER[data] & begins, solid)
    length = share(~W._SPACE[data] & begins, n)
    solid_at = np.maximum.accumulate(np.where(W._SPACE[data], -1, np.arange(len(data)))) if len(data) else np.zeros(0, np.int64)
    last = data[solid_at[end - 1]] if len(end) else np.zeros(0, np.uint8)
    bounds = np.searchsorted(row, np.arange(part.rows + 1))
    opening, closing = np.zeros(len(n), bool), np.zeros(len(n), bool)
    full = bounds[1:] > bounds[:-1]
    opening[bounds[:-1][full]] = True
    closing[bounds[1:][full] - 1] = True
    features = np.column_stack(
        [
            np.ones(len(n), bool), n <= 2, (n > 2) & (n <= 7), (n > 7) & (n < 20), n >= 20, symbols > 0.01, symbols > 0.08, symbols > 0.2, share(_DIGIT[data], solid) > 0.05,
            share(_DIGIT[data], solid) > 0.25, share(_UPPER[data], solid) > 0.4, share(_SHOUT[data], n) > 0.5, _STOP[last], before, again > 0.05, again > 0.4, length > 9, length < 3.2,
            opening, closing, letters < 0.7,
        ]
    ).astype(np.float32)
    dup = np.bincount(row, weights=before, minlength=part.rows).astype(np.int64)
    repeat = np.bincount(words.row, weights=covered, minlength=part.rows).astype(np.int64)
    return Measured(np.diff(words.bounds), part.per_row(begins & ~W._SPACE[data]), part.per_row(_SYMBOL[data]), dup, repeat, bounds, features, n, line_hash)


def _steps(bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(t, lines at place t of the documents that have one), documents from the longest to the shortest."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begin, active = bounds[:-1][order], len(order)
    for t in range(int(sizes.max(initial=0))):
        while active and sizes[order[active - 1]] <= t:
            active -= 1
        yield t, begin[:active] + t


def viterbi(scores: np.ndarray, transition: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The best states of each document's lines. scores: [line, state]; all documents advance together."""
    back = np.zeros(scores.shape, dtype=np.int8)
    best = scores.astype(float).copy()
    for t, lines in _steps(bounds):
        if t:
            ways = best[lines - 1][:, :, None] + transition[None]
            back[lines] = ways.argmax(axis=1)
            best[lines] = ways.max(axis=1) + scores[lines]
    states = np.zeros(len(scores), dtype=np.int8)
    full = np.flatnonzero(np.diff(bounds))
    ends = bounds[1:][full] - 1
    states[ends] = best[ends].argmax(axis=1)
    walk = list(_steps(bounds))
    for t, lines in reversed(walk):
        if t:
            states[lines - 1] = back[lines, states[lines]]
    return states


def fit_field(features: np.ndarray, states: np.ndarray, bounds: np.ndarray, fit: Fit) -> Field:
    """Maximum likelihood with a ridge, by gradient steps with momentum over expected counts from forward-backward sums.
    A document counts the same whatever its number of lines."""
    n_docs = max(1, int((np.diff(bounds) > 0).sum()))
    weight = np.repeat(1 / np.maximum(np.diff(bounds), 1), np.diff(bounds))
    emission, transition = np.zeros((features.shape[1], 2)), np.zeros((2, 2))
    velocity = [np.zeros_like(emission), np.zeros_like(transition)]
    gold = np.eye(2)[states]
    steps = list(_steps(bounds))
    for step in range(fit.steps):
        scores = features @ emission
        forward, backward = scores.copy(), np.zeros_like(scores)
        for t, lines in steps:
            if t:
                forward[lines] = np.logaddexp.reduce(forward[lines - 1][:, :, None] + transition[None], axis=1) + scores[lines]
        for t, lines in reversed(steps):
            if t:
                backward[lines - 1] = np.logaddexp.reduce(transition[None] + (scores[lines] + backward[lines])[:, None, :], axis=2)
        single = forward + backward
        single = np.exp(single - np.logaddexp.reduce(single, axis=1, keepdims=True))
        pull = features.T @ ((gold - single) * weight[:, None]) / n_docs - fit.shrink * 1e-4 * emission
        push = np.zeros((2, 2))
        for t, lines in steps:
            if t:
                pair = forward[lines - 1][:, :, None] + transition[None] + (scores[lines] + backward[lines])[:, None, :]
                pair = np.exp(pair - np.logaddexp.reduce(pair.reshape(len(lines), 4), axis=1)[:, None, None])
                push += ((gold[lines - 1][:, :, None] * gold[lines][:, None, :] - pair) * weight[lines][:, None, None]).sum(axis=0)
        push = push / n_docs - fit.shrink * 1e-2 * transition
        velocity = [0.9 * velocity[0] + pull, 0.9 * velocity[1] + push]
        emission, transition = emission + velocity[0], transition + velocity[1]
    return Field(emission, transition)


def _spread(docs: DataFrame, text_col: str, wanted: np.ndarray) -> dict[int, int]:
    """Of the lines with the hashes ``wanted`` (ascending): after how many different lines each stands, over all documents. A
    copy of a document adds nothing, so this tells lines that sites share from lines of texts that were copied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column(0)):
                m = measure(part)
                h = m.line_hashes
                before = np.concatenate((np.zeros(1, np.uint64), h[:-1])) if len(h) else h
                before[m.bounds[:-1][np.diff(m.bounds) > 0]] = 0
                hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
                pairs = np.unique(np.column_stack([h[hit], before[hit]]), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["line", "before"])

    pairs = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "line long, before long").distinct()
    counted = pairs.groupBy("line").agg(F.count("*").alias("n")).toArrow()  # at most sample_lines rows
    return dict(zip(counted.column(0).to_pylist(), counted.column(1).to_pylist(), strict=True))


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fit the field on at most ``fit.sample_rows`` labelled documents with at most ``fit.sample_lines`` lines altogether.

    Lines of a document of quality 0 count as boilerplate; of those of quality 1, the ones that stand after
    ``fit.contexts`` different lines or more over all documents, and the others as content. Without rows of both labels the
    field marks every line as content."""
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).dropDuplicates(["__id"])
    chosen = scratch.materialize(chosen.orderBy(F.xxhash64(F.lit(5), "__id"), "__id").limit(fit.sample_rows), "sampled")
    sample = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(F.col("__id").alias("id"), F.col(text_col).cast("string").alias("text"), F.col("__label").alias("label"))
    breaks = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))), F.lit(0)).cast("long")
    sized = sample.groupBy("id").agg(F.max(breaks + 1).alias("n")).orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(fit.sample_rows).collect()
    total, fitting = 0, []
    for r in sized:
        if total + r["n"] <= fit.sample_lines:
            total += r["n"]
            fitting.append((r["id"],))
    kept = docs.sparkSession.createDataFrame(fitting, sample.select("id").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column(1)):
                m = measure(part)
                ends = list(zip(m.bounds[:-1], m.bounds[1:], strict=True))
                cells = [np.packbits(m.features[a:b].astype(bool), axis=1).tobytes() for a, b in ends]
                hashes = [m.line_hashes[a:b].tobytes() for a, b in ends]
                cut = [batch.column(i).slice(part.first, part.rows) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*cut, pa.array(cells, pa.binary()), pa.array(hashes, pa.binary())], ["id", "label", "lines", "hashes"])

    bounded = sample.join(F.broadcast(kept), "id").select("id", "text", "label")  # at most sample_rows ids
    measured = bounded.mapInArrow(run, f"id {sample.schema['id'].dataType.simpleString()}, label int, lines binary, hashes binary")
    rows = measured.orderBy("id", "hashes").limit(fit.sample_rows).collect()
    width = (len(FEATURES) + 7) // 8
    lines = [np.unpackbits(np.frombuffer(r["lines"], np.uint8).reshape(-1, width), axis=1)[:, : len(FEATURES)] for r in rows]
    sizes = [len(x) for x in lines]
    if len({r["label"] for r in rows}) < 2 or not sum(sizes):
        return Field(np.array([[0.0, 1.0]] + [[0.0, 0.0]] * (len(FEATURES) - 1)), np.zeros((2, 2)))
    hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
    spread = _spread(docs, text_col, np.unique(hashes))
    shared = np.array([spread.get(h, 0) >= fit.contexts for h in hashes.view(np.int64).tolist()])
    states = np.repeat([r["label"] for r in rows], sizes) * ~shared
    return fit_field(np.concatenate(lines).astype(float), states, np.concatenate(([0], np.cumsum(sizes))), fit)


def rate(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeated: int = 50, least_content: float = 0.5) -> DataFrame:
    """One row for each row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs), n_lines and
    content_lines (lines with a word; those marked as content), content_share (of words, in content lines; 0 without
    words), base_failed and kept.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeated`` per cent of the words in three-word
    windows that the text holds twice or more. kept: not base_failed, and content_share at least ``least_content``. Null
    and empty texts have no words and so fail. Whole texts are read; other columns are ignored.
    """
    plain = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "content_lines"]
    schema = docs.select(id_col).schema
    for name in names:
        schema = schema.add(name, "long")
    schema = schema.add("content_share", "double").add("base_failed", "boolean").add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column(1)):
                m = measure(part)
                states = viterbi(m.features @ field.emission, field.transition, m.bounds)
                row = np.repeat(np.arange(part.rows), np.diff(m.bounds))
                content = np.bincount(row, weights=states, minlength=part.rows)
                good = np.bincount(row, weights=states * m.line_words, minlength=part.rows)
                share = good / np.maximum(m.n_words, 1)
                failed = (m.n_words < least_words) | (100 * m.n_repeat_words > most_repeated * m.n_words)
                longs = [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, np.diff(m.bounds), content]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.rows), *[pa.array(x.astype(np.int64)) for x in longs], pa.array(share), pa.array(failed), pa.array(~failed & (share >= least_content))], schema.names
                )

    return plain.mapInArrow(run, schema)
