"""Connected components of an edge table by contraction, all in joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm import scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (a long, b long), any order, repeats and loops allowed. Returns (id, component): each node that occurs in
    an edge once, with the smallest id that it reaches. No edges, no rows; edges with a null end are ignored.

    The edges that a partition happens to hold are replaced by stars around the smallest id of what they connect. In each
    pass every node then chooses one among its neighbours and itself, and takes what that one chose: in even passes the
    smallest id, which settles stars at once; in odd ones that with the smallest hash, which shortens chains of any order.
    The graph is contracted to the nodes so taken; what were edges within one are gone, so that edges and nodes shrink
    geometrically. When no edge is left, the passes' choices are followed back. Choices are combined before the shuffle, so a
    node with many edges is no hot key there, and what the passes write to the shared folder cuts lineage.
    """
    few = max(1, -(-edges.count() // _EDGES))  # tasks that hold all edges

    def ends(rows: DataFrame, a: str, b: str) -> DataFrame:
        pairs = rows.where(f"{a} <> {b}").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
        return pairs.coalesce(few).mapInArrow(_stars, "a long, b long")

    left = scratch.materialize(ends(edges, "a", "b"), "edges")
    passes: list[DataFrame] = []
    while not left.isEmpty():
        place = lambda c: F.struct(F.xxhash64(F.lit(len(passes)), c) if len(passes) % 2 else c, c)  # noqa: E731, B023
        ways = left.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("w")).select("w.*")
        chosen = ways.groupBy("id").agg(F.min_by("to", place(F.col("to"))).alias("to"))
        chosen = chosen.select("id", F.when(place(F.col("to")) < place(F.col("id")), F.col("to")).otherwise(F.col("id")).alias("to"))
        taken = chosen.join(_named(chosen, "to", "beyond"), "to").select("id", F.col("beyond").alias("to"))
        passes.append(scratch.materialize(taken, "choices"))
        both = left.join(_named(passes[-1], "a", "to_a"), "a").join(_named(passes[-1], "b", "to_b"), "b")
        left = scratch.materialize(ends(both, "to_a", "to_b"), "edges")
    if not passes:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    # The smallest id below each node of a pass, up to the last pass; then down again, to every node.
    least = [passes[0].groupBy("to").agg(F.min("id").alias("least"))]
    for step in passes[1:]:
        below = step.join(_named(least[-1], "id", "least", key="to", value="least"), "id")
        least.append(below.groupBy("to").agg(F.min("least").alias("least")))
    top = None
    for step, own in zip(reversed(passes), reversed(least), strict=True):
        if top is not None:  # nodes that had no edge left in the next pass are as they were
            own = own.join(_named(top, "to", "component", value="component"), "to", "left").select("to", F.coalesce("component", "least").alias("least"))
        top = step.join(own, "to").select("id", F.col("least").alias("component"))
    return scratch.materialize(top, "components")


#: Edges that a task handles at once.
_EDGES = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (least id, id) that connect the same nodes as the partition's edges, or each _EDGES of them."""
    held, n = [], 0
    for batch in batches:
        held.append(np.column_stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))]))
        n += len(held[-1])
        if n >= _EDGES:
            yield _star(np.concatenate(held))
            held, n = [], 0
    if n:
        yield _star(np.concatenate(held))


def _star(edges: np.ndarray) -> pa.RecordBatch:
    ids, at = np.unique(edges, return_inverse=True)
    u, v = at.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        low = np.minimum(label[u], label[v])
        for x in (u, v, label[u], label[v]):
            np.minimum.at(new, x, low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    leaf = label != np.arange(len(ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[label[leaf]]), pa.array(ids[leaf])], ["a", "b"])


def _named(choices: DataFrame, name: str, to: str, key: str = "id", value: str = "to") -> DataFrame:
    of: list[Column] = [F.col(key).alias(name), F.col(value).alias(to)]
    return choices.select(*of)
