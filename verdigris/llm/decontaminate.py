"""Benchmark decontamination on templates.

Numbers, units after numbers, and names (capitalised words inside a sentence, but not in a run of upper-case words) become
typed placeholders. Windows of the resulting templates are hash-joined between documents and benchmark items, so that a
question asked again with other numbers or names still joins. A window goes on until it holds some literal tokens, so that
questions made of numbers are matched by longer windows. Windows with other values than the item's only count if their
alignment's slots are consistent, but for a few coincidences: one value of the item stands for one value of the document.

Names are known by Latin capitals, units by a list of English, German, French and Spanish words; a name in another script
is a literal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm import scratch
from verdigris.llm import words as W

#: Words that are units where a number stands before them.
UNITS = (
    "mm cm m km g kg mg lb lbs oz l ml s ms h min mile miles metre metres meter meters litre litres liter liters gram grams "
    "second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro "
    "euros pound pounds percent degrees sekunden minuten stunde stunden tag tage woche wochen monat monate jahr jahre prozent "
    "grad heure heures jour jours semaine semaines mois an ans secondes hora horas día días semana semanas mes meses año años "
    "segundos minutos"
).split()
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[[0x2C, 0x2E]] = True
_END = np.zeros(256, dtype=bool)
_END[[0x0A, 0x0D, 0x21, 0x2E, 0x3A, 0x3F]] = True


@dataclass(frozen=True)
class Templates:
    """width: tokens of a window at least; it goes on until ``literals`` of its tokens are literal. share: part of an item's
    windows that a document must hold. run: or so many windows of it in a row, 20 tokens with the values here. An item
    without any such window is one window: of its own length, if it is shorter than ``width`` or has two literals or more;
    else its windows are matched by their own words. coincidences: of an alignment's slots, so many may stand for another
    value than that which the item's value stands for mostly. broadcast_windows: up to so many distinct window hashes are
    sent to executors (8 bytes each) to drop others before the join; with more, all windows are joined by a shuffle, each
    side's hot hashes dealt out over ``salts`` tasks. broadcast_rows: up to so many of the items' windows are joined by a
    broadcast (about 100 bytes each)."""

    width: int = 8
    literals: int = 4
    share: float = 0.4
    run: int = 13
    coincidences: float = 0.25
    salts: int = 16
    broadcast_windows: int = 4_000_000
    broadcast_rows: int = 500_000


@dataclass
class Tokens:
    """A slice's tokens in order: template hashes, hashes of their own (folded) bytes, and slot values (0: literal)."""

    template: np.ndarray
    own: np.ndarray
    slots: np.ndarray
    bounds: np.ndarray  # tokens of each document


def _fold(part: W.Slice) -> np.ndarray:
    """Lower-cased A-Z and Latin-1 capitals of two-byte sequences."""
    data = W.lower(part).copy()
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][upper] += 0x20
    return data


def _running(mask: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))


def tokens(part: W.Slice) -> Tokens:
    data = part.data
    inside = _ALNUM[data]
    if len(data) > 2:  # 3.5 and 1,000 are one token
        inside[1:-1] |= _POINT[data[1:-1]] & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
    spans = W.spans(inside, part.bounds)
    n = len(spans.start)
    folded = _fold(part)
    literal = W.span_hashes(folded, spans.start, spans.end)
    if not n:
        return Tokens(literal, literal, literal, np.zeros(part.rows + 1, np.int64))
    digits, ends = _running(_DIGIT[data]), _running(_END[data])
    has_digit = digits[spans.end] > digits[spans.start]
    number = has_digit & _DIGIT[data[spans.start]]
    follows = np.zeros(n, dtype=bool)
    follows[1:] = spans.row[1:] == spans.row[:-1]
    after_number = np.zeros(n, dtype=bool)
    after_number[1:] = number[:-1] & follows[1:]
    unit = after_number & np.isin(literal, _unit_hashes()) & ~number
    gap_end = np.ones(n, dtype=bool)
    gap_end[1:] = (ends[spans.start[1:]] > ends[spans.end[:-1]]) | ~follows[1:]
    raised = _running(folded != data)
    n_raised = raised[spans.end] - raised[spans.start]
    letters = _running(_ALNUM[data] & ((data & 0xC0) != 0x80))
    n_chars = letters[spans.end] - letters[spans.start]
    two = (data[spans.start] == 0xC3).astype(np.int64)
    capital = raised[np.minimum(spans.start + 1 + two, spans.end)] > raised[spans.start]
    shout = capital & (n_raised >= n_chars)
    beside = np.zeros(n, dtype=bool)
    beside[1:] |= shout[:-1]
    beside[:-1] |= shout[1:]
    name = capital & ~gap_end & ~number & (n_chars > 1) & ((n_raised == 1) | (shout & ~beside))
    kind = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))
    template = np.where(kind > 0, W.mix(kind.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)), literal)
    slots = np.where(kind > 0, literal | np.uint64(1), np.uint64(0))
    return Tokens(template, literal, slots, spans.bounds)


@dataclass
class Windows:
    """Windows of a slice's documents, in order: their tokens are first .. last - 1 of the slice."""

    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    row: np.ndarray


def _hashed(values: np.ndarray, first: np.ndarray, last: np.ndarray, kind: int) -> np.ndarray:
    """64-bit hashes of runs of values; equal runs of one kind are alike wherever they stand."""
    return W.RunHasher(values)(first, last) ^ W.mix(np.array([kind], dtype=np.uint64))[0]


def template_windows(t: Tokens, width: int, literals: int) -> Windows:
    """The shortest windows from each token on that have ``width`` tokens and ``literals`` literals within the document."""
    n = len(t.template)
    plain = np.flatnonzero(t.slots == 0)
    first = np.arange(n)
    nth = np.searchsorted(plain, first) + literals - 1
    enough = np.where(nth < len(plain), plain[np.minimum(nth, max(len(plain) - 1, 0))] + 1 if len(plain) else n + 1, n + 1)
    last = np.maximum(first + width, enough)
    row = np.repeat(np.arange(len(t.bounds) - 1), np.diff(t.bounds))
    fits = last <= t.bounds[row + 1]
    first, last, row = first[fits], last[fits], row[fits]
    return Windows(_hashed(t.template, first, last, 1), first, last, row)


def exact_windows(t: Tokens, width: int) -> Windows:
    """All runs of ``width`` tokens, by their own words."""
    return _fixed(t, t.own, width, 2)


def whole_windows(t: Tokens, width: int) -> Windows:
    """All runs of ``width`` tokens, by their template: where items of just this length may stand."""
    return _fixed(t, t.template, width, 3)


def _fixed(t: Tokens, values: np.ndarray, width: int, kind: int) -> Windows:
    first = np.arange(len(values))
    row = np.repeat(np.arange(len(t.bounds) - 1), np.diff(t.bounds))
    fits = first + width <= t.bounds[row + 1]
    first, row = first[fits], row[fits]
    return Windows(_hashed(values, first, first + width, kind), first, first + width, row)


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer("".join(UNITS).encode(), dtype=np.uint8)
    end = np.cumsum([len(u) for u in UNITS])
    return W.span_hashes(data, end - [len(u) for u in UNITS], end)


_HITS = "hash long, at long, of long, slots array<long>"


def _batch(ids: pa.Array, part: W.Slice, t: Tokens, found: Windows, keep: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    """Rows of the windows ``keep``: the document's id, hash, place in the document, its number of windows, slot values."""
    first, sizes = found.first[keep], (found.last - found.first)[keep]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(first - offsets[:-1], sizes) + np.arange(offsets[-1])
    slots = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(t.slots[at].view(np.int64)))
    row = found.row[keep]
    columns = [ids.take(pa.array(part.first + row)), pa.array(found.hashes[keep].view(np.int64)), pa.array(first - t.bounds[row]), pa.array(of[row].astype(np.int64)), slots]
    return pa.RecordBatch.from_arrays(columns, ["id", "hash", "at", "of", "slots"])


def _item_windows(items: DataFrame, templates: Templates) -> DataFrame:
    """items: (id, text). A row for each window: id, hash, at, of, slots, and length: of a window that is a whole item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column(1)):
                t = tokens(part)
                size = np.diff(t.bounds)
                usual = template_windows(t, templates.width, templates.literals)
                count = np.bincount(usual.row, minlength=part.rows)
                literal = np.add.reduceat(np.append(t.slots == 0, False).astype(np.int64), t.bounds[:-1]) * (size > 0)
                whole = (size > 0) & (count == 0) & ((size < templates.width) | (literal >= 2))
                poor = (size > 0) & (count == 0) & ~whole
                yield from _with_length(_batch(batch.column(0), part, t, usual, np.arange(len(usual.hashes)), count), 0)
                own = exact_windows(t, templates.width)
                yield from _with_length(_batch(batch.column(0), part, t, own, np.flatnonzero(poor[own.row]), np.bincount(own.row, minlength=part.rows)), -1)
                for length in np.unique(size[whole]).tolist():
                    of_length = whole_windows(t, length)
                    keep = np.flatnonzero(whole[of_length.row] & (size[of_length.row] == length))
                    yield from _with_length(_batch(batch.column(0), part, t, of_length, keep, np.ones(part.rows)), length)

    return items.mapInArrow(run, f"id {items.schema['id'].dataType.simpleString()}, {_HITS}, length int")


def _with_length(batch: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, length, np.int32))], [*batch.schema.names, "length"])


def _document_windows(docs: DataFrame, templates: Templates, lengths: list[int], wanted: np.ndarray | None) -> DataFrame:
    """docs: (id, text). A row for each window: id, hash, at, of, slots; of all kinds that items have, and with ``wanted``,
    hashes in ascending order, only of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column(1)):
                t = tokens(part)
                for length in lengths:
                    found = template_windows(t, templates.width, templates.literals) if length == 0 else exact_windows(t, templates.width) if length < 0 else whole_windows(t, length)
                    keep = np.arange(len(found.hashes))
                    if wanted is not None:
                        keep = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, found.hashes), len(wanted) - 1)] == found.hashes) if len(wanted) else keep[:0]
                    if len(keep):
                        yield _batch(batch.column(0), part, t, found, keep, np.bincount(found.row, minlength=part.rows))

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, {_HITS}")


def contaminated(docs: DataFrame, items: DataFrame, templates: Templates = Templates(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item of which the document holds ``templates.share`` of the windows or more, or
    ``templates.run`` of them in a row.

    Returns id_col, item_col, windows long (of the item, found in the document as they are or by consistent alignments), item_windows
    long, reparameterised boolean (a slot has another value than in the item).
    Null and empty texts match nothing; rows with a null id are ignored. Repeated rows give the pair once. Empty tables
    give an empty result. Other columns are ignored.
    """
    plain = lambda df, key, text: df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    bench = scratch.materialize(_item_windows(plain(items, item_col, item_text), templates), "items")
    lengths = sorted(r[0] for r in bench.select("length").distinct().collect())  # as many as short items have lengths
    distinct = bench.select("hash").distinct()
    small = distinct.count() <= templates.broadcast_windows
    wanted = np.sort(distinct.toArrow().column(0).to_numpy().view(np.uint64)) if small else None
    own = _document_windows(plain(docs, id_col, text_col), templates, lengths, wanted)
    side = bench.select("hash", F.col("id").alias("item"), F.col("at").alias("item_at"), F.col("of").alias("item_of"), F.col("slots").alias("item_slots"))
    if small and bench.count() <= templates.broadcast_rows:
        hits = own.join(F.broadcast(side), "hash")
    else:
        dealt = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(templates.salts - 1))))
        hits = own.withColumn("salt", F.pmod(F.xxhash64("id", "at"), F.lit(templates.salts)).cast("int")).join(dealt, ["hash", "salt"])
    hits = hits.select("id", "item", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "item_of", "slots", "item_slots")
    hits = scratch.materialize(hits.distinct(), "hits")
    run = ["id", "item", "shift"]
    slots = hits.select(*run, "item_at", F.posexplode(F.arrays_zip("item_slots", "slots")).alias("i", "s"))
    slots = slots.select(*run, (F.col("item_at") + F.col("i")).alias("place"), F.col("s.item_slots").alias("theirs"), F.col("s.slots").alias("ours")).where("theirs <> 0 AND ours <> 0").distinct()
    values = slots.groupBy(*run, "theirs", "ours").agg(F.count("*").alias("n")).groupBy(*run, "theirs").agg(F.max("n").alias("agree"), F.sum("n").alias("n"))
    judged = values.groupBy(*run).agg((F.sum("n") - F.sum("agree")).alias("odd"), F.sum("n").alias("n"))
    other = F.exists(F.arrays_zip("item_slots", "slots"), lambda s: (s["item_slots"] != 0) & (s["slots"] != 0) & (s["item_slots"] != s["slots"]))
    good = hits.withColumn("other", other).join(judged, run, "left").where(f"odd IS NULL OR odd <= {templates.coincidences} * n OR NOT other")
    kept = good.groupBy(*run, "item_at").agg(F.max("item_of").alias("item_of"), F.min("other").alias("other"))
    row = kept.withColumn("row", F.col("item_at") - F.row_number().over(Window.partitionBy(*run).orderBy("item_at")))
    rows = row.groupBy(*run, "row").agg(F.count("*").alias("long"), F.collect_list("item_at").alias("ats"), F.max("item_of").alias("item_of"), F.max("other").alias("other"))
    return (
        rows.withColumn("item_at", F.explode("ats"))
        .groupBy("id", "item")
        .agg(F.countDistinct("item_at").alias("windows"), F.max("item_of").alias("item_windows"), F.max("other").alias("reparameterised"), F.max("long").alias("long"))
        .where((F.col("windows") >= templates.share * F.col("item_windows")) | (F.col("long") >= templates.run))
        .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "windows", "item_windows", "reparameterised")
    )
