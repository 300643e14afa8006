"""Best-fit packing of tokenised documents into sequences of bounded length.

Pieces of equal length are interchangeable, so the plan is made for a histogram: at most as many counts as a sequence has
tokens, however large the corpus. Best-fit decreasing gives the first solution. Where it needs more sequences than a lower
bound says, bin completion searches for a better one: around the largest piece that is left, undominated fillings are
tried one after the other, the fullest first, as often as the counts allow, and a branch is left once it has wasted more
than a better solution may. Ranked pieces then find their places in the plan.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import scratch
from verdigris.llm import words as W
from verdigris.llm.prefix import global_prefix

#: A filling: (length, how many), longest first.
Filling = tuple[tuple[int, int], ...]
#: A plan: (how many sequences, their filling).
Plan = list[tuple[int, Filling]]


@dataclass(frozen=True)
class PackRule:
    """Sequences hold up to ``capacity`` tokens; every document ends in token ``end``. The search opens up to ``nodes``
    nodes with up to ``fillings`` fillings each; ``cache_words`` distinct words' tokens are remembered."""

    capacity: int = 2048
    end: int = 0
    nodes: int = 4_000
    fillings: int = 6
    cache_words: int = 700_000


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No plan has fewer sequences: the larger of the total's share and, for each threshold k, the pieces that can't lie
    together and what they leave of the pieces of k or more."""
    lengths = sorted(counts)
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in [n for n in lengths if 2 * n <= capacity]:
        alone = sum(counts[n] for n in lengths if n > capacity - k)
        pairs = [n for n in lengths if capacity - k >= n > capacity / 2]
        room = sum(counts[n] * (capacity - n) for n in pairs)
        small = sum(counts[n] * n for n in lengths if k <= n <= capacity / 2)
        best = max(best, alone + sum(counts[n] for n in pairs) + max(0, -(-(small - room) // capacity)))
    over_half = sum(c for n, c in counts.items() if 2 * n > capacity)
    return max(best, over_half)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, sequences with equal contents at once."""
    rooms: dict[int, dict[Filling, int]] = {}  # by free room, the sequences by what they hold
    free: list[int] = []

    def put(room: int, filling: Filling, n: int) -> None:
        if room not in rooms:
            rooms[room] = {}
            free.insert(bisect_left(free, room), room)
        rooms[room][filling] = rooms[room].get(filling, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(free, length)
            if at == len(free):
                room, filling, have = capacity, (), left
            else:
                room = free[at]
                filling, have = rooms[room].popitem()
                if not rooms[room]:
                    del rooms[room], free[at]
            each = room // length
            whole = min(have, left // each)
            if whole:
                put(room - each * length, (*filling, (length, each)), whole)
                left -= whole * each
            some = min(left, each) if whole < have else 0
            if some:
                put(room - some * length, (*filling, (length, some)), 1)
                left -= some
            if at < len(free) or filling:
                rest = have - whole - bool(some)
                if rest and filling:
                    put(room, filling, rest)
    return [(n, filling) for held in rooms.values() for filling, n in held.items()]


def _fillings(counts: dict[int, int], lengths: list[int], largest: int, capacity: int, least: int, limit: int) -> list[tuple[int, Filling]]:
    """Up to ``limit`` undominated fillings around one piece of ``largest``, by waste: (waste, filling). ``lengths`` are
    those with a count, ascending. Fillings that leave more than ``least`` free are left out.

    A single piece as long as the room dominates all other fillings of this room, and a filling that another piece could
    join is dominated by the one with it. Longer pieces are tried first, since they are harder to place later."""
    found: list[tuple[int, Filling]] = []
    smallest = lengths[0]
    steps = 0

    def down(room: int, top: int, held: list[int], used: dict[int, int]) -> None:
        nonlocal steps
        steps += 1
        if counts.get(room, 0) > used.get(room, 0) and room <= top:
            found.append((0, tuple(held) + (room,)))
            return
        deeper = False
        at = bisect_right(lengths, min(room, top)) - 1
        while at >= 0 and len(found) < limit and steps < 64 * limit:
            length = lengths[at]
            at -= 1
            if counts[length] <= used.get(length, 0):
                continue
            deeper = True
            used[length] = used.get(length, 0) + 1
            down(room - length, length, [*held, length], used)
            used[length] -= 1
        if not deeper and room <= least and not any(n <= room and counts[n] > used.get(n, 0) for n in lengths[: bisect_right(lengths, room)]):
            found.append((room, tuple(held)))

    room = capacity - largest
    held = {largest: 1}
    if counts.get(room, 0) > held.get(room, 0):
        return [(0, _packed((largest, room)))]
    # Two pieces that fill the room exactly come before all that takes more pieces.
    if room >= smallest:
        for length in reversed(lengths[bisect_left(lengths, (room + 1) // 2) : bisect_right(lengths, room)]):
            other = room - length
            if other and counts.get(other, 0) > held.get(other, 0) + (other == length) and counts[length] > held.get(length, 0):
                found.append((0, (largest, length, other)))
                if len(found) >= limit // 2:
                    break
    down(room, largest, [largest], held)
    unique = {_packed(f): w for w, f in found}
    return sorted(((w, f) for f, w in unique.items()), key=lambda wf: (wf[0], [-n for n, _ in wf[1]], wf[1]))[:limit]


def _packed(lengths: tuple[int, ...]) -> Filling:
    out: dict[int, int] = {}
    for n in sorted(lengths, reverse=True):
        out[n] = out.get(n, 0) + 1
    return tuple(out.items())


def complete(counts: dict[int, int], capacity: int, rule: PackRule) -> Plan:
    """The plan with the fewest sequences that best fit and the search find."""
    best = best_fit(counts, capacity)
    fewest = sum(n for n, _ in best)
    bound = lower_bound(counts, capacity)
    if fewest <= bound or not counts:
        return best
    total = sum(n * c for n, c in counts.items())
    left = dict(counts)
    lengths = sorted(left)

    def take(filling: Filling, times: int) -> None:
        for n, k in filling:
            left[n] -= k * times
            if not left[n]:
                del left[n], lengths[bisect_left(lengths, n)]

    def give(filling: Filling, times: int) -> None:
        for n, k in filling:
            if n not in left:
                left[n] = 0
                lengths.insert(bisect_left(lengths, n), n)
            left[n] += k * times

    # A level of the path: its fillings, which of them is in use, how often, and the waste before it.
    path: list[list] = []
    waste, nodes, forward = 0, 0, True
    while nodes < rule.nodes and fewest > bound:
        if forward and not lengths:
            fewest = sum(level[2] for level in path)
            best = [(level[2], level[0][level[1]][1]) for level in path]
            forward = False
        elif forward:
            nodes += 1
            allowed = (fewest - 1) * capacity - total
            path.append([_fillings(left, lengths, lengths[-1], capacity, allowed - waste, rule.fillings), -1, 0, waste])
            forward = False
        if not path:
            break
        level = path[-1]
        options, chosen, times, before = level
        allowed = (fewest - 1) * capacity - total
        if chosen >= 0:
            give(options[chosen][1], times)
            waste = before
        if times > 1:  # once less; what is left goes on with another filling of the same piece or of others
            times -= 1
        else:
            chosen += 1
            if chosen < len(options):
                times = min(left[n] // k for n, k in options[chosen][1])
        if chosen >= len(options):
            path.pop()
            continue
        level[1], level[2] = chosen, times
        take(options[chosen][1], times)
        waste = before + times * options[chosen][0]
        forward = waste <= allowed
        nodes += not forward
    return best


#: Bytes of text tokenised at once; longer texts are cut at spaces.
SLICE_BYTES = 4 << 20
_STOP = np.isin(np.arange(256), list(b".,;:!?|"))
_PLAIN = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_SMALL = re.compile("[a-zà-öø-ÿ]+")


def _cut(part: W.Slice) -> Iterator[W.Slice]:
    """The slice, or a long single text in pieces that end at spaces."""
    at, n = 0, len(part.data)
    if n <= 2 * SLICE_BYTES:
        yield part
        return
    while at < n:
        to = min(at + SLICE_BYTES, n)
        while to < n and not _SPACE[part.data[to]]:
            to += 1
        yield W.Slice(part.first, 1, part.data[at:to], np.array([0, to - at]), part.valid)
        at = to


class WordTokens:
    """Token ids of texts, word by word, each distinct word but once; words are told apart by 64-bit hashes.

    The tokenizer must drop white space, ignore case, and part letters and digits from punctuation before it merges
    anything: then a word has the same tokens wherever it stands, a full stop behind a word is a word of its own, and a
    word of small letters goes to the merges as it is. Texts with combining marks, which join letters, or with the
    beginning of a special token are neither lower-cased nor parted before. ``cache_words`` words are remembered.
    """

    def __init__(self, path: str, cache_words: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_words = Tokenizer.from_file(path), cache_words
        self.merges = self.tokenizer.model.tokenize
        letters = [chr(c) for c in range(0xE0, 0x100) if c != 0xF7]
        self.as_bytes = {ord(c): "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in letters}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.sizes, self.ids = array("q"), array("I")

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            small = [_SMALL.fullmatch(w) is not None for w in some]
            got = self.tokenizer.encode([w for w, p in zip(some, small, strict=True) if not p], is_pretokenized=True, add_special_tokens=False)
            other = iter(np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)).tolist() if got.ids else [0] * len(some))
            ids, used = got.ids, 0
            for word, p in zip(some, small, strict=True):
                if p:
                    own = [t.id for t in self.merges(word if word.isascii() else word.translate(self.as_bytes))]
                    self.ids.extend(own)
                    self.sizes.append(len(own))
                else:
                    n = next(other)
                    self.ids.extend(ids[used : used + n])
                    self.sizes.append(n)
                    used += n

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; a null has none."""
        for part in W.slices(column, SLICE_BYTES):
            pieces = [self._tokens(p) for p in _cut(part)]
            if len(pieces) > 1:
                yield np.concatenate([ids for ids, _ in pieces])
            else:
                ids, ends = pieces[0]
                yield from np.split(ids, ends[:-1])

    def _tokens(self, part: W.Slice) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice, and where those of each text end."""
        if len(self.known) > self.cache_words:
            self._clear()
        raw = part.data
        special = np.zeros(len(raw), bool)
        special[:-1] = (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        rough = part.per_row((raw == 0xCC) | (raw == 0xCD) | special) > 0
        data, found = W.lower(part), W.words(part)
        if rough.any():
            data = np.where(np.repeat(rough, np.diff(part.bounds)), raw, data)
        start, end = found.start, found.end
        # Stops behind a plain letter or digit are words of their own.
        last = np.maximum.accumulate(np.where(_STOP[data], -1, np.arange(len(data)))) if len(data) else np.zeros(0, np.int64)
        stem = np.where(rough[found.row], end, last[end - 1] + 1)
        parted = np.flatnonzero((stem > start) & (stem < end) & _PLAIN[data[np.maximum(stem - 1, 0)]])
        bounds = found.bounds + np.searchsorted(parted, found.bounds)
        start, end = np.insert(start, parted + 1, stem[parted]), np.insert(end, parted, stem[parted])
        hashes, first, inverse = np.unique(W.span_hashes(data, start, end), return_index=True, return_inverse=True)
        numbers = np.fromiter(map(self.known.get, hashes.tolist(), repeat(-1)), np.int64, len(hashes))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = len(self.known) + np.arange(len(new))
            self.known.update(zip(hashes[new].tolist(), numbers[new].tolist(), strict=True))
            whole = data.tobytes()
            self._learn([whole[a:b].decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
        sizes, ids = np.array(self.sizes, np.int64), np.frombuffer(self.ids, np.uint32)
        begin = np.cumsum(sizes) - sizes
        at = numbers[inverse]
        own = sizes[at]
        ends = np.concatenate(([0], np.cumsum(own)))
        return ids[np.repeat(begin[at] - ends[:-1], own) + np.arange(ends[-1])], ends[bounds[1:]]


@lru_cache(maxsize=1)
def _word_tokens(path: str, cache_words: int) -> WordTokens:
    """One for each worker, so that later tasks know the words of earlier ones."""
    return WordTokens(path, cache_words)


_PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, rule: PackRule) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's tokens with the end token, cut every ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _word_tokens(tokenizer, rule.cache_words)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = [c.split(" ")[0] for c in _PIECES.split(", ")]
        for batch in batches:
            rows = []
            for doc, found in zip(batch.column(0).to_pylist(), tokens(batch.column(1)), strict=True):
                ids = np.append(found, np.uint32(rule.end)).astype("<u4", copy=False)
                for piece, start in enumerate(range(0, len(ids), rule.capacity)):
                    part = ids[start : start + rule.capacity]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.selectExpr(f"cast(`{id_col}` as long) AS id", f"cast(`{text_col}` as string) AS text").mapInArrow(run, _PIECES)


def _places(plan: Plan, counts: dict[int, int]) -> np.ndarray:
    """Intervals of ranked pieces, ascending by length: rows (first rank, first sequence, pieces a sequence, offset)."""
    rank = dict(zip(sorted(counts), np.cumsum([0] + [counts[n] for n in sorted(counts)]).tolist(), strict=False))
    rows, sequence = [], 0
    for times, filling in plan:
        offset = 0
        for length, each in filling:
            rows.append((rank[length], sequence, each, offset))
            rank[length] += times * each
            offset += length * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int, rule: PackRule, order: list[str], length_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (both long) to pieces of 1 to ``capacity`` tokens, any columns.

    order: columns that, after the length, tell pieces apart; rows alike in all of them may change places. Sequences are
    numbered from 0, offsets in a sequence are gapless from 0. Columns with these two names are replaced. An empty table
    gives an empty result. The driver sees one count a length; the plan it broadcasts has a few rows for each of these.
    """
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most ``capacity`` rows
    places = pieces.sparkSession.sparkContext.broadcast(_places(complete(counts, capacity, rule), counts))
    ranked = global_prefix(pieces, [F.col(length_col), *map(F.col, order)], {}, "__at")
    keep = pieces.columns
    where = keep.index(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequence, each, offset = places.value.T
        for batch in batches:
            at = np.asarray(batch.column(len(keep)), np.int64)
            row = np.searchsorted(first, at, side="right") - 1
            behind = at - first[row]
            found = sequence[row] + behind // each[row]
            start = offset[row] + behind % each[row] * np.asarray(batch.column(where), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found), pa.array(start)], [*keep, "sequence_id", "offset"])

    schema = pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return ranked.select(*keep, "__at").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", rule: PackRule = PackRule()) -> DataFrame:
    """Pack whole documents into sequences of up to ``rule.capacity`` tokens; only longer ones are cut.

    tokenizer: path of a tokenizer file that every worker can read, whose pre-tokenizer never goes over a space.
    Returns (id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece: piece from 0, start the number of
    the document's tokens before it, ids_crc32 unsigned over little-endian 32-bit ids. A null or empty text is the end
    token alone. Ids may be null or repeated: each row of docs is packed. Other columns are ignored.
    """
    pieces = scratch.materialize(tokenised_pieces(docs, tokenizer, id_col, text_col, rule), "pieces")
    return pack(pieces, rule.capacity, rule, ["id", "piece", "start", "ids_crc32"])
