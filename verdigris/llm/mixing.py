"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm import scratch
from verdigris.llm import words as W
from verdigris.llm.prefix import global_prefix

#: Source tables of up to so many rows are sent to every executor; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 100_000
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def measure(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, size, quality): size counts words (runs of bytes other than ASCII white space); quality, from 0.05 to
    1, falls with the share of a text's bytes that are neither letters nor white space. A null or empty text has size 0
    and quality 0.05."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column(2)):
                found = W.words(part)
                letters = part.per_row(_LETTER[part.data])
                solid = part.per_row(~W._SPACE[part.data])
                quality = np.clip(2.5 * letters / np.maximum(solid, 1) - 1.4, 0.05, 1.0)
                cut = [batch.column(i).slice(part.first, part.rows) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*cut, pa.array(np.diff(found.bounds).astype(np.int64)), pa.array(quality)], ["id", "source", "size", "quality"])

    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, source string, size long, quality double")


def water_fill(sources: DataFrame, budget: float, cap: float) -> DataFrame:
    """Share ``budget`` among sources by weight, none above ``cap`` times its size, the excess reshared by weight.

    sources: (source, source_size, weight). Returns it with ``target`` double. The shares are level * weight or the cap;
    the level rises as sources reach their caps, until no more do. Each pass is one aggregate of the source table.
    """
    full = F.col("source_size") * cap
    level, before = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") >= full
        capped, weight, n = sources.agg(F.sum(F.when(over, full).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if n == before or not weight:
            break
        before, level = n, max((budget - capped) / weight, level)
    return sources.withColumn("target", full if not weight and weight is not None else F.least(F.lit(level) * F.col("weight"), full))


def exponential_key(id_col: Column, quality: Column, seed: int) -> Column:
    """-ln(u) / quality, u a uniform number from a hash of the id: the smallest keys are a sample without replacement in
    which a document's chance follows its quality."""
    u = (F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / quality


def mix(measured: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """How often each document is taken so that its source gives about its target.

    measured: (id, source, size, quality) as from ``measure``; targets: (source, source_size, target), null a source like
    any other. Complete epochs come first: every document of a source is taken floor(target / source_size) times. The rest
    of the target is filled in the order of exponential keys scaled by quality: a prefix sum of sizes, and the documents
    up to the one that comes nearest to the budget are taken once more. A third of all rows may have one source: the sums
    run over a global order of (source, key), which splits it.

    Returns id, source, size, source_size, target, copies long. Rows of sources without a target have copies 0. Rows that
    are alike in all columns may change places; reruns agree else. An empty table gives an empty result.
    """
    keyed = measured.withColumn("key", exponential_key(F.col("id"), F.col("quality"), seed))
    order = [F.coalesce("source", F.lit("")), F.col("source").isNull(), F.col("key"), F.col("id")]
    placed = global_prefix(keyed, order, {"before": "size"}, "__row")
    placed = scratch.materialize(placed.select("id", "source", "size", "before"), "mixed")
    starts = placed.groupBy("source").agg(F.min("before").alias("start"))
    known = scratch.materialize(targets.join(starts, targets["source"].eqNullSafe(starts["source"])).select(targets["source"].alias("__source"), "source_size", "target", "start"), "targets")
    side = F.broadcast(known) if known.count() <= BROADCAST_SOURCES else known
    joined = placed.join(side, F.col("source").eqNullSafe(F.col("__source")), "left")
    epochs = F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    left = F.col("target") - epochs * F.col("source_size")
    within = F.col("before") - F.col("start")
    copies = epochs + F.when((within + F.col("size") / 2 <= left) & (left >= 0.5), 1).otherwise(0)  # under half a word nothing is left to fill
    return joined.select("id", "source", "size", "source_size", "target", F.coalesce(copies, F.lit(0)).cast("long").alias("copies"))


def ranked_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Give the sources, by code point with null last, the weights in turn. sources: a row a source; their ranks are counted
    over range partitions, so that there may be as many sources as web domains."""
    ranked = global_prefix(sources, [F.col("source").isNull(), F.coalesce("source", F.lit(""))], {}, "__rank")
    choices = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.withColumn("weight", F.element_at(choices, (F.col("__rank") % len(weights) + 1).cast("int"))).drop("__rank")


def mix_documents(docs: DataFrame, weights: tuple[float, ...], share: float, cap: float, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7) -> DataFrame:
    """Mix whole documents: sources weigh ``weights`` in turn by code point (null last), share ``share`` times the total
    size, and give at most ``cap`` times their own. Returns what ``mix`` returns. Null and empty texts have size 0."""
    measured = scratch.materialize(measure(docs, id_col, source_col, text_col), "measured")
    sizes = scratch.materialize(ranked_weights(measured.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "sources")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    return mix(measured, water_fill(sizes, share * total, cap).select("source", "source_size", "target"), seed)
