"""Spelling variants: words that differ by one letter, grouped below their most frequent form.

The vocabulary is cut, in sorted order, into shards, each packed as a compact trie: nodes level by level, one byte a label,
and where a single word goes on, the word itself. The tries are broadcast in groups of bounded size, and each word's
Levenshtein automaton of distance one walks them depth-first, emitting the words that it accepts.

An automaton with its edit still to come passes every branch, so near the root it would go nearly everywhere. An edit
leaves either the first half of a word or the second half untouched, so each word walks twice: edits in its second half in
the tries of words, edits in its first half in those of reversed words, each time straight ahead up to the middle. Shards
that hold no word with that half are dead at the root and aren't visited.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import scratch

#: Letters whose runs are words; one byte each in Latin-1, whose order is that of code points.
LETTERS = "A-Za-zÀ-ÿ"

#: What a document's run of letters (lower-cased, at least ``least_length`` letters) counts as: (id, run) -> word.
Change = Callable[[int | None, str], str]


@dataclass(frozen=True)
class VariantRule:
    """Words have ``least_length`` letters or more and occur ``least_count`` times or more; a form is ``ratio`` times as
    frequent as the word or more. Tries hold up to ``shard_words`` words, and those of up to ``broadcast_bytes`` are
    broadcast at once; a task searches for about ``task_words`` words."""

    least_length: int = 7
    least_count: int = 2
    ratio: int = 10
    shard_words: int = 50_000
    broadcast_bytes: int = 64 << 20
    task_words: int = 20_000


def _lower(word: str) -> str:
    """A-Z lower-cased, all else as it is."""
    return word.lower() if word.isascii() else word.encode("latin-1").lower().decode("latin-1")


def count_words(docs: DataFrame, id_col: str, text_col: str, rule: VariantRule, change: Change | None = None) -> DataFrame:
    """(word, n) of all maximal runs of letters of whole texts, A-Z lower-cased, ``change`` applied, that are long enough
    then. Documents are counted slice by slice before rows are made."""
    pattern = re.compile(f"[{LETTERS}]{{{rule.least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = cell.as_py()
                if text is None:
                    continue
                if change is None:
                    total.update(map(_lower, pattern.findall(text)))
                else:
                    for found, n in Counter(map(_lower, pattern.findall(text))).items():
                        word = change(doc, found)
                        if len(word) >= rule.least_length:
                            total[word] += n
                if len(total) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    source = docs.selectExpr(f"cast(`{id_col}` as long) AS id", f"cast(`{text_col}` as string) AS text")
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """A compact trie of sorted words (Latin-1 bytes) with their counts.

    Nodes stand level by level, so a node's children are the nodes ``first[u] .. first[u + 1] - 1`` and their labels lie
    side by side in ``labels``. ``word[u]`` is the word that ends at u, or -1; a node without children below which one
    word goes on has that word, whose rest is compared as it stands.
    """

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        self.words, self.counts = words, counts
        labels, self.first, self.word = bytearray(1), array("I", [1]), array("i")
        level = [(0, len(words), 0)]  # of each node: its words, its depth
        while level:
            below = []
            for lo, hi, depth in level:
                ends = len(words[lo]) == depth
                self.word.append(lo if ends or hi - lo == 1 else -1)
                if hi - lo > 1:
                    at = lo + ends
                    while at < hi:
                        letter = words[at][depth]
                        to = at + 1 if at + 1 == hi or words[at + 1][depth] != letter else bisect_right(words, letter, at, hi, key=lambda w, d=depth: w[d])
                        labels.append(letter)
                        below.append((at, to, depth + 1))
                        at = to
                self.first.append(len(labels))
            level = below
        self.labels = bytes(labels)

    def pack(self) -> tuple:
        return b"\n".join(self.words), array("q", self.counts).tobytes(), self.labels, self.first.tobytes(), self.word.tobytes()

    @classmethod
    def unpack(cls, packed: tuple) -> Trie:
        self = cls.__new__(cls)
        words, counts, self.labels, first, word = packed
        self.words = words.split(b"\n")
        self.counts, self.first, self.word = array("q"), array("I"), array("i")
        self.counts.frombytes(counts), self.first.frombytes(first), self.word.frombytes(word)
        return self

    def near(self, word: bytes, straight: int) -> set[int]:
        """Numbers of the words, other than ``word``, that the automaton of distance one accepts and whose first
        ``straight`` letters are those of ``word``."""
        first, labels, ends, words = self.first, self.labels, self.word, self.words
        size, out = len(word), set()
        node = at = 0
        lo, hi = first[0], first[1]
        while at < straight and lo < hi:
            node = labels.find(word[at], lo, hi)
            if node < 0:
                return out
            at += 1
            lo, hi = first[node], first[node + 1]
        if lo == hi and at < straight:
            found = words[ends[node]]
            return {ends[node]} if found.startswith(word[:straight]) and _one_edit(word, found) else out
        # A state is (node, letters of the word read) and, once the edit has been made, the node's depth.
        edited: list[tuple[int, int, int]] = []
        while True:
            lo, hi = first[node], first[node + 1]
            if lo == hi:
                if _one_edit(word[at:], words[ends[node]][at:]):
                    out.add(ends[node])
                break
            if at == size - 1 and ends[node] >= 0:
                out.add(ends[node])
            if at + 1 < size:  # a letter left out
                child = labels.find(word[at + 1], lo, hi)
                if child >= 0:
                    edited.append((child, at + 2, at + 1))
            edited += [(child, at, at + 1) for child in range(lo, hi)]  # a letter more
            if at == size:
                break
            edited += [(child, at + 1, at + 1) for child in range(lo, hi)]  # another letter
            node = labels.find(word[at], lo, hi)
            if node < 0:
                break
            at += 1
        for node, at, depth in edited:
            while True:
                lo, hi = first[node], first[node + 1]
                if lo == hi:
                    if words[ends[node]][depth:] == word[at:]:
                        out.add(ends[node])
                    break
                if at == size:
                    if ends[node] >= 0:
                        out.add(ends[node])
                    break
                node = labels.find(word[at], lo, hi)
                if node < 0:
                    break
                at += 1
                depth += 1
        return {i for i in out if words[i] != word}


def _one_edit(a: bytes, b: bytes) -> bool:
    """Whether a and b differ by exactly one letter left out, put in or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    at = 0
    while at < len(b) and a[at] == b[at]:
        at += 1
    return a[at + 1 :] == (b[at + 1 :] if len(a) == len(b) else b[at:])


_SHARD = "backwards boolean, head string, tail string, bytes long, words binary, counts binary, labels binary, first binary, word binary"


def _shards(vocabulary: DataFrame, rule: VariantRule, n: int) -> DataFrame:
    """The tries of words and of reversed words, with the first and last word of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backwards, words, counts = None, [], []

        def full() -> pa.RecordBatch:
            packed = Trie(words, counts).pack()
            cells = [backwards, words[0].decode("latin-1"), words[-1].decode("latin-1"), sum(map(len, packed)), *packed]
            kinds = [pa.bool_(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names)

        names = [c.split(" ")[0] for c in _SHARD.split(", ")]
        for batch in batches:
            for way, word, count in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if words and (way != backwards or len(words) >= rule.shard_words):
                    yield full()
                    words, counts = [], []
                backwards = way
                words.append(word.encode("latin-1"))
                counts.append(count)
        if words:
            yield full()

    ahead = vocabulary.select(F.lit(False).alias("backwards"), "word", "n")
    back = vocabulary.select(F.lit(True).alias("backwards"), F.reverse("word").alias("word"), "n")
    return ahead.union(back).repartitionByRange(n, "backwards", "word").sortWithinPartitions("backwards", "word").mapInArrow(run, _SHARD)


def _search(words: DataFrame, tries: list, backwards: bool) -> DataFrame:
    """(word, n_near, best, best_n): accepted words of these tries, counted, and the most frequent, of equals the first."""
    shared = words.sparkSession.sparkContext.broadcast(tries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = [head.encode("latin-1") for head, _, _ in shared.value]
        tails = [tail.encode("latin-1") for _, tail, _ in shared.value]
        ready = [Trie.unpack(packed) for _, _, packed in shared.value]
        for batch in batches:
            rows: list[tuple] = []
            for word in batch.column(0).to_pylist():
                plain = word.encode("latin-1")
                half = len(plain) // 2
                asked, straight = (plain[::-1], len(plain) - half) if backwards else (plain, half)
                ahead = asked[:straight]
                n, best, best_n = 0, b"", 0
                k = max(bisect_right(heads, ahead) - 1, 0)
                while k < len(heads) and (heads[k] <= ahead or heads[k].startswith(ahead)):
                    if tails[k] >= ahead:
                        trie = ready[k]
                        for i in trie.near(asked, straight):
                            found = trie.words[i]
                            if backwards:
                                found = found[::-1]
                                if found.startswith(plain[:half]):
                                    continue  # met in the tries of words
                            n += 1
                            count = trie.counts[i]
                            if count > best_n or count == best_n and found < best:
                                best, best_n = found, count
                    k += 1
                if n:
                    rows.append((word, n, best.decode("latin-1"), best_n))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "best", "best_n"])

    return words.select("word").mapInArrow(run, "word string, n_near long, best string, best_n long")


def near_words(vocabulary: DataFrame, rule: VariantRule) -> DataFrame:
    """vocabulary: (word, n), written. Returns (word, n_near, best, best_n) for words with near words; each row covers the
    tries of one broadcast, so a word may have several."""
    spark = vocabulary.sparkSession
    size = vocabulary.count()
    shards = scratch.materialize(_shards(vocabulary, rule, max(1, -(-2 * size // rule.shard_words))), "tries")
    heads = shards.select("backwards", "head", "tail", "bytes").orderBy("backwards", "head").collect()  # one short row a trie
    groups: list[list] = []
    for row in heads:
        if not groups or groups[-1][0].backwards != row.backwards or sum(r.bytes for r in groups[-1]) + row.bytes > rule.broadcast_bytes:
            groups.append([])
        groups[-1].append(row)
    found = []
    for group in groups:
        way, head, tail = group[0].backwards, group[0].head, group[-1].tail
        rows = shards.where((F.col("backwards") == way) & F.col("head").between(head, tail)).orderBy("head").collect()
        tries = [(r.head, r.tail, (r.words, r.counts, r.labels, r.first, r.word)) for r in rows]
        half = F.expr("cast(length(word) div 2 as int)")
        start = F.expr("reverse(substring(word, 1 + cast(length(word) div 2 as int)))") if way else F.substring(F.col("word"), F.lit(1), half)
        asked = vocabulary.where((start <= tail) & ((start >= head) | F.startswith(F.lit(head), start)))
        found.append(scratch.materialize(_search(asked.repartition(max(1, -(-size // rule.task_words)), "word"), tries, way), "near"))
    if not found:
        return spark.createDataFrame([], "word string, n_near long, best string, best_n long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: VariantRule = VariantRule(), change: Change | None = None) -> DataFrame:
    """Every word of the vocabulary with its near words and the form that it is a variant of.

    Words are maximal runs of letters of whole texts, A-Z lower-cased and nothing else, after ``change``, of at least
    ``rule.least_length`` letters and ``rule.least_count`` occurrences. Near words differ by exactly one letter inserted,
    deleted or replaced. Returns word, n (occurrences), n_near, form (the near word of largest n, of equals the first by
    code points, if it is ``rule.ratio`` times as frequent; else null), form_n, root (from word, forms followed to the
    last; the word itself if it has none). One row a word, in no order.

    Null and empty texts have no words; null ids are handed to ``change`` as None; repeated rows count; an empty table
    gives an empty result; other columns are ignored.
    """
    counted = count_words(docs, id_col, text_col, rule, change).where(F.col("n") >= rule.least_count)
    vocabulary = scratch.materialize(counted, "vocabulary")
    near = near_words(vocabulary, rule).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max(F.struct("best_n")).getField("best_n").alias("best_n"), F.min(F.struct(-F.col("best_n"), F.col("best"))).getField("best").alias("best"))
    is_form = F.col("best_n") >= rule.ratio * F.col("n")
    judged = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    judged = scratch.materialize(judged, "forms")
    # A form is ``ratio`` times as frequent as its word, so chains are short; each round doubles the way followed.
    largest = judged.agg(F.max("n")).first()[0] or 1
    longest = 1
    while rule.ratio > 1 and rule.ratio ** (longest + 1) <= largest:
        longest += 1
    roots, reached = judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 1
    while reached < longest:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = scratch.materialize(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reached *= 2
    return judged.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
