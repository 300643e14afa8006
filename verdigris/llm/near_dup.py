"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every document's set of word shingles is hashed; documents with equal sets collapse to a class. Each class appears in
several sorted orders ("trees"), each by its own sequence of MinHash values. Neighbours in an order that share a long
enough prefix are candidates: where a region is dense its neighbours share a longer prefix, so the depth adapts to the
region. Candidates are confirmed on the full shingle sets, and classes joined by confirmed links form components.

Rounds keep large groups cheap, since documents that a round has tied into one component are never paired again. The first
round confirms direct neighbours of a few orders, which ties up most of a group of thousands of near copies with a link or
two a member. The second takes direct neighbours of all orders that are still in different components. The third looks
further back, in those runs of equal prefixes that the second leaves open. Runs that are longer than it looks back, or that
a boundary of two range partitions cuts, are finished exactly, by a prefix-filter join on their documents' rarest shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm import scratch
from verdigris.llm import words as W
from verdigris.llm.components import connected_components


@dataclass(frozen=True)
class Forest:
    """trees x least_depth MinHash functions make the orders; a tree's order goes on with the next trees' functions. With
    ``more`` functions they make the sketch, two bits of each value, by which candidates are sifted: a pair at exactly
    ``percent`` has ``slack`` standard deviations to spare, and is lost once in three million cases with 5.

    A pair of similarity s shares a prefix of ``least_depth`` in some tree but for (1 - s**least_depth)**trees: 0.000003
    at 0.8 with the values here. The first round pairs neighbours of ``first_trees`` orders. ``reach`` is how far back the
    third round looks for another component's documents with such a prefix; longer runs are joined by shingles, a hot
    shingle's documents in blocks of ``block``. Up to ``broadcast_ids`` ids of documents with candidates are sent to the texts,
    which else are shuffled. The sets that most rows share, ``hot_sets`` at most, reach their rows by a
    broadcast, so that no task gets all copies of a text.
    """

    width: int = 5
    percent: int = 80
    trees: int = 24  # up to 255
    first_trees: int = 3
    least_depth: int = 4
    key_depth: int = 10
    more: int = 288
    reach: int = 8
    block: int = 256
    hot_sets: int = 10_000
    broadcast_ids: int = 1_000_000
    slack: float = 5.0
    seed: int = 20260101

    @property
    def functions(self) -> int:
        return self.trees * self.least_depth + self.more

    @property
    def least_agreement(self) -> float:
        """Of the sketches' two-bit fields, how many agree at least; unlike values agree in one field of four."""
        p = self.percent / 100 + (1 - self.percent / 100) / 4
        return p - self.slack * (p * (1 - p) / self.functions) ** 0.5


def _functions(forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(forest.seed)
    n = forest.functions
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _sets(part: W.Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    w = W.words(part)
    hashes = W.span_hashes(W.lower(part), w.start, w.end)
    return W.distinct(*W.windows(hashes, w.bounds, width, short=True))


def _packed(sig: np.ndarray) -> np.ndarray:
    """The lowest two bits of every value, four values a byte."""
    low = np.zeros((len(sig), -(-sig.shape[1] // 4) * 4), np.uint8)
    low[:, : sig.shape[1]] = sig & np.uint32(3)
    return low[:, 0::4] | low[:, 1::4] << 2 | low[:, 2::4] << 4 | low[:, 3::4] << 6


#: How many of a byte's four fields are zero.
_ZEROS = sum((np.arange(256) >> shift & 3 == 0).astype(np.int64) for shift in (0, 2, 4, 6))


def _agree(x: np.ndarray, y: np.ndarray, forest: Forest) -> np.ndarray:
    """Whether packed sketches, a row each, agree well enough."""
    padding = x.shape[1] * 4 - forest.functions
    return _ZEROS[x ^ y].sum(axis=1) - padding >= forest.least_agreement * forest.functions


def signatures(docs: DataFrame, forest: Forest) -> DataFrame:
    """docs: (id long, text string). Returns (id, n_shingles long, set_a long, set_b long, signature binary, sketch binary);
    a document without words has n_shingles 0 and null signatures. The signature has the orders' functions in big-endian
    form, the sketch two bits of every function."""
    ordered = forest.trees * forest.least_depth
    mult, add = _functions(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column(1)):
                hashes, bounds = _sets(part, forest.width)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                sums = np.zeros((2, part.rows), dtype=np.uint64)
                sig = np.zeros((len(full), len(mult)), dtype=np.uint32)
                if len(full):
                    at = bounds[:-1][full]
                    sums[0, full] = np.add.reduceat(W.mix(hashes), at)
                    sums[1, full] = np.add.reduceat(W.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), at)
                    short = (hashes >> np.uint64(32)).astype(np.uint32)
                    value = np.empty_like(short)
                    for k in range(len(mult)):
                        np.multiply(short, mult[k], out=value)
                        np.add(value, add[k], out=value)
                        sig[:, k] = np.minimum.reduceat(value, at)
                cells: list[bytes | None] = [None] * part.rows
                sketches: list[bytes | None] = [None] * part.rows
                for i, row, low in zip(full.tolist(), sig[:, :ordered].astype(">u4"), _packed(sig), strict=True):
                    cells[i], sketches[i] = row.tobytes(), low.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.rows), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(cells, pa.binary()), pa.array(sketches, pa.binary())],
                    ["id", "n_shingles", "set_a", "set_b", "signature", "sketch"],
                )

    return docs.mapInArrow(run, "id long, n_shingles long, set_a long, set_b long, signature binary, sketch binary")


def _orders(classes: DataFrame, forest: Forest, places: DataFrame | None = None) -> DataFrame:
    """classes: (id, signature, component, sketch; the last may be left out). A row for each class and tree, or for each of
    ``places`` (id, tree), sorted within range partitions of a tree's order. The id ends the order, so that a long run of
    equal keys is split between partitions."""
    own, deep = forest.least_depth * 4, forest.key_depth * 4
    return (
        (classes.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(forest.trees)]))) if places is None else classes.join(places, "id"))
        .select("tree", F.expr(f"substring(concat(signature, signature), tree * {own} + 1, {deep})").alias("key"), "id", "component", *[c for c in classes.columns if c == "sketch"])
        .repartitionByRange("tree", "key", "id")
        .sortWithinPartitions("tree", "key", "id")
    )


#: What _neighbours gives: pairs (a, b) without a run, or a document a of component b in a run. A pair (a, a) says only
#: that a has a neighbour.
_FOUND = "a long, b long, run binary, place long"


def _neighbours(forest: Forest, reach: int, runs: bool) -> Callable:
    """Over sorted rows (tree, key, id, component[, sketch]): pairs at most ``reach`` apart that share ``least_depth`` values
    of a tree's order, belong to different components, and have sketches that agree well enough.

    Besides, what these pairs leave open. With ``runs``: all documents of a run of equal prefixes longer than the reach
    that has several components (place -1), and those of a partition's first and last run (place: the partition).
    Without: a partition's first and last document (place: their order); and of orders beyond the first trees no pairs, only
    the documents that have a neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept_id, kept_sketch = np.zeros((0, 1 + forest.key_depth), np.uint32), np.zeros((0, 2), np.int64), np.zeros((0, -(-forest.functions // 4)), np.uint8)
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []  # ids of the run that the next batch may go on with
        held_prefix, first_run, last = b"", True, None

        def members(prefix: bytes, ids: np.ndarray, place: int) -> pa.RecordBatch:
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array([prefix] * n, pa.binary()), pa.array(np.full(n, place))], ["a", "b", "run", "place"])

        def closed(prefix: bytes, ids: np.ndarray, edge: bool) -> Iterator[pa.RecordBatch]:
            if len(ids) > reach + 1 and (ids[:, 1] != ids[0, 1]).any():
                yield members(prefix, ids, -1)
            if edge:
                yield members(prefix, ids, part)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u4").reshape(n, forest.key_depth)
            key = np.column_stack([np.asarray(batch.column(0)).astype(np.uint32), key.astype(np.uint32)])
            ids = np.column_stack([np.asarray(batch.column(2)), np.asarray(batch.column(3))])
            own = np.ascontiguousarray(key[:, : 1 + forest.least_depth])
            if not runs:
                if last is None:
                    yield members(own[0].tobytes(), ids[:1], 2 * part)
                last = own[-1].tobytes(), ids[-1:]
            else:
                starts = np.concatenate(([0], np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1, [n]))
                sizes = np.diff(starts)
                ends = {0, len(sizes) - 1}
                for i in sorted(ends | set(np.flatnonzero(sizes > reach + 1).tolist())):
                    prefix, mine = own[starts[i]].tobytes(), ids[starts[i] : starts[i + 1]]
                    if i in ends:
                        if held and prefix != held_prefix:
                            yield from closed(held_prefix, np.concatenate(held), first_run)
                            held, first_run = [], False
                        held, held_prefix = [*held, mine], prefix
                    else:
                        yield from closed(prefix, mine, False)
            key, ids, new = np.concatenate([kept_key, key]), np.concatenate([kept_id, ids]), len(kept_key)
            sketch = None
            if batch.num_columns > 4:
                sketch = np.concatenate([kept_sketch, np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(n, -1)])
                kept_sketch = sketch[-reach:]
            found = []
            prefix = key[:, : 1 + forest.least_depth]
            for back in range(1, min(reach, len(key) - 1) + 1):
                lo = max(new, back)
                here, there = slice(lo, len(key)), slice(lo - back, len(key) - back)
                ok = (prefix[here] == prefix[there]).all(axis=1)
                if not ok.any():
                    break
                ok &= ids[here, 1] != ids[there, 1]
                if sketch is not None:
                    near = np.flatnonzero(ok)
                    ok[near[~_agree(sketch[here][near], sketch[there][near], forest)]] = False
                found.append(np.column_stack([np.minimum(ids[there, 0][ok], ids[here, 0][ok]), np.maximum(ids[there, 0][ok], ids[here, 0][ok])]))
            kept_key, kept_id = key[-reach:], ids[-reach:]
            if found:
                pairs = np.concatenate(found)
                if not runs:
                    tree = key[max(new, 1) :, 0][ok]
                    pairs = np.concatenate([pairs[tree < forest.first_trees], np.repeat(np.unique(pairs[tree >= forest.first_trees]), 2).reshape(-1, 2)])
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.binary()), pa.nulls(len(pairs), pa.int64())], ["a", "b", "run", "place"])
        if held:
            yield from closed(held_prefix, np.concatenate(held), True)
        if last is not None:
            yield members(*last, 2 * part + 1)

    return run


def _across(found: DataFrame) -> DataFrame:
    """Pairs (a, b) of direct neighbours, those on either side of a partition's boundary included."""
    before = F.lag("a").over(Window.partitionBy("run").orderBy("place"))  # two rows a partition
    over = found.where("run IS NOT NULL").select("a", before.alias("before")).where("before <> a")
    return found.where("run IS NULL").select("a", "b").union(over.select(F.least("a", "before"), F.greatest("a", "before"))).distinct()


def _unfinished(found: DataFrame) -> DataFrame:
    """(id, tree) of documents in runs of several components that are longer than the reach or go over a boundary."""
    tree = F.conv(F.hex(F.substring("run", 1, 1)), 16, 10).cast("int").alias("tree")  # a run begins with its tree's number, low byte first
    edge = found.where("place >= 0")
    cut = edge.groupBy("run").agg(F.min("place").alias("p"), F.max("place").alias("q"), F.min("b").alias("b"), F.max("b").alias("c")).where("p <> q AND b <> c").select("run")
    over = edge.join(F.broadcast(cut), "run", "left_semi")  # cut: at most a run for each partition
    return found.where("place < 0").select(F.col("a").alias("id"), tree).union(over.select("a", tree)).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


#: Shingles are counted in so many buckets; only the order of a prefix depends on the counts.
_BUCKETS = 1 << 20


def _dense_pairs(members: DataFrame, forest: Forest) -> DataFrame:
    """members: (id, component, text). All pairs of different components that can be alike by ``percent``: sets so
    alike share one of their |x| - ceil(percent * |x| / 100) + 1 rarest shingles, in any order that holds for all of them.
    What stands behind the shared shingle on either side bounds how many more can be shared. Of a shingle's documents, those
    of its most frequent component are never paired with each other."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BUCKETS, np.int64)
        for batch in batches:
            for part in W.slices(batch.column(0)):
                np.add.at(total, (_sets(part, forest.width)[0] % np.uint64(_BUCKETS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = members.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(_BUCKETS, np.int32)
    often[counted.column(0).to_numpy()] = np.minimum(counted.column(1).to_numpy(), np.iinfo(np.int32).max)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column(2)):
                hashes, bounds = _sets(part, forest.width)
                n = np.diff(bounds)
                row = np.repeat(np.arange(part.rows), n)
                order = np.lexsort((hashes, often[(hashes % np.uint64(_BUCKETS)).astype(np.int64)], row))
                behind = n[row] - 1 - (np.arange(len(order)) - bounds[row])
                early = behind >= ((forest.percent * n + 99) // 100 - 1)[row]
                keep = order[early]
                at = pa.array(part.first + row[early])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(n[row[early]]), pa.array(behind[early])], ["hash", "id", "component", "n", "behind"])

    postings = scratch.materialize(members.select("id", "component", "text").mapInArrow(rarest, "hash long, id long, component long, n long, behind long"), "postings")
    shares = postings.groupBy("hash", "component").agg(F.count("*").alias("m"))
    hot = shares.groupBy("hash").agg(F.max_by("component", "m").alias("main"), F.sum("m").alias("total"), F.count("*").alias("parts")).where("parts > 1")
    keyed = scratch.materialize(postings.join(hot.select("hash", "main", F.ceil(F.col("total") / forest.block).alias("blocks")), "hash"), "keyed")
    left = keyed.where("component <> main").select("hash", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("behind").alias("bx"))
    right = keyed.select("hash", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.col("id").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("behind").alias("by"), "main")
    enough = f"100 * least(nx, ny) >= {forest.percent} * greatest(nx, ny) AND {100 + forest.percent} * (1 + least(bx, by)) >= {forest.percent} * (nx + ny)"
    both = left.join(right, ["hash", "block"]).where(f"cx <> cy AND (cy = main OR x < y) AND {enough}")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _sift(pairs: DataFrame, heads: DataFrame, forest: Forest) -> DataFrame:
    """The pairs (a, b) whose sketches agree well enough; heads: (id, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(_agree(x, y, forest)))

    side = lambda name: heads.select(F.col("id").alias(name), F.col("sketch").alias(f"sketch_{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, forest: Forest) -> DataFrame:
    """pairs (a, b) whose shingle sets have 100 * intersection >= percent * union; texts: (id, text), ids unique. Texts that
    are written in buckets by id are read where they are; a pair carries one of its two texts through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for at in range(0, batch.num_rows, 128):
                both = pa.concat_arrays([left.slice(at, 128), right.slice(at, 128)])
                m = len(both) // 2
                sets: list[np.ndarray] = []
                for part in W.slices(both):
                    hashes, bounds = _sets(part, forest.width)
                    sets += [hashes[bounds[i] : bounds[i + 1]] for i in range(part.rows)]
                ok = np.zeros(m, dtype=bool)
                for i in range(m):
                    x, y = sets[i], sets[m + i]
                    shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    ok[i] = 100 * shared >= forest.percent * (len(x) + len(y) - shared)
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + m][ok]), pa.array(b[at : at + m][ok])], ["a", "b"])

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest = Forest()) -> DataFrame:
    """Group documents whose word-shingle sets are alike, through chains of links.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A document's set is its distinct shingles
    of ``forest.width`` words; with fewer words, the whole sequence is one shingle. A link is a confirmed similarity of
    ``forest.percent`` per cent or more.

    Returns for each input row: id, n_shingles, component_id (smallest id reachable, its own included), kept (id is
    component_id). Texts without words (null, empty, white space) have n_shingles 0, and no links. Rows with equal sets
    are one class and never paired with each other. Rows that repeat an id give a row each; their ids should have one
    text. Rows with a null id keep n_shingles, and have a null component and kept false. Other columns are ignored. An
    empty table gives an empty result.
    """
    since = scratch.mark(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    table = scratch.materialize(signatures(plain, forest), "signatures")
    classes = scratch.materialize(
        table.where("id IS NOT NULL AND n_shingles > 0")
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("id").alias("rep"), F.count("*").alias("rows"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")),
        "classes",
    )
    heads = classes.groupBy(F.col("rep").alias("id")).agg(F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))

    first = scratch.materialize(_orders(heads.select("id", "signature", F.col("id").alias("component")), forest).mapInArrow(_neighbours(forest, 1, False), _FOUND).distinct(), "first")
    near = scratch.materialize(_across(first), "near")
    involved = scratch.materialize(heads.join(_ends(near), "id", "left_semi"), "involved")
    ids = involved.select("id")
    mine = plain.join(F.broadcast(ids) if ids.limit(forest.broadcast_ids + 1).count() <= forest.broadcast_ids else ids, "id", "left_semi")
    texts = scratch.bucketed(mine, "id", "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return scratch.materialize(_confirm(pairs, texts, forest), "links")

    def tied_by(links: DataFrame, of: DataFrame) -> DataFrame:
        return of.join(connected_components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))

    close = scratch.materialize(_sift(near.where("a <> b"), involved, forest), "close")
    links = confirmed(close)
    second = scratch.materialize(_orders(tied_by(links, involved.drop("sketch")), forest).mapInArrow(_neighbours(forest, 1, True), _FOUND).distinct(), "second")
    fresh = second.where("run IS NULL").select("a", "b").join(near, ["a", "b"], "left_anti")
    closer = scratch.materialize(_sift(fresh, involved, forest), "close")
    links = links.union(confirmed(closer))
    places = scratch.materialize(_unfinished(second), "places")
    left = scratch.materialize(tied_by(links, involved.join(places.select("id").distinct(), "id", "left_semi")), "left")
    third = scratch.materialize(_orders(left, forest, places).mapInArrow(_neighbours(forest, forest.reach, True), _FOUND).distinct(), "third")
    beyond = third.where("run IS NULL").select("a", "b")
    dense = scratch.materialize(left.select("id", "component").join(_unfinished(third).select("id").distinct(), "id", "left_semi").join(texts, "id"), "dense")
    if not dense.isEmpty():
        beyond = beyond.union(_sift(_dense_pairs(dense, forest), involved, forest))
    known = close.union(closer)
    links = links.union(confirmed(beyond.distinct().join(known, ["a", "b"], "left_anti")))

    sets = ["set_a", "set_b", "n_shingles"]
    groups = classes.join(connected_components(links).withColumnRenamed("id", "rep"), "rep", "left")
    groups = scratch.materialize(groups.select(*sets, "rows", F.coalesce("component", "rep").alias("component_id")), "groups")
    hot = groups.orderBy(F.desc("rows"), *sets).limit(forest.hot_sets).drop("rows")
    rows = table.where("id IS NOT NULL AND n_shingles > 0").select("id", *sets)
    many = rows.join(F.broadcast(hot), sets)  # at most hot_sets rows
    few = rows.join(F.broadcast(hot), sets, "left_anti").join(groups.drop("rows"), sets)
    none = table.where("id IS NULL OR n_shingles = 0").select("id", *sets, F.col("id").alias("component_id"))
    out = many.unionByName(few).unionByName(none)
    out = out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return scratch.settle(out, "near_duplicates", since)
