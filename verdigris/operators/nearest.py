"""Cosines of many queries with many items, a block of queries and a block of items at a time, as products of matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most items and most queries of one task; how many of each are multiplied at a time.
ITEMS, QUERIES, STEP_ITEMS, STEP_QUERIES = 65_536, 16_384, 32_768, 128

#: Most items of one task that have words besides.
TEXTS = 16_384

#: For a block's items and queries, each query's rows of the items and their scores.
Scores = Callable[[pa.Table, pa.Table], Iterable[tuple[np.ndarray, np.ndarray]]]

#: Scores by product of matrices and those summed in order differ by less than this.
_ROOM = 1e-9


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _in_order(a: np.ndarray, b: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Scalar products of chosen rows, summed in the order of the elements as ``similarity.dot`` does."""
    total = np.zeros(len(rows))
    for j in range(a.shape[1]):
        total += a[rows, j] * b[others, j]
    return total


def _norms(m: np.ndarray) -> np.ndarray:
    every = np.arange(len(m))
    return np.sqrt(_in_order(m, m, every, every))


def _scored(items: pa.Table, queries: pa.Table, k: int | None, least: float | None, weight: float | None, also: Scores | None = None) -> pa.Table:
    """The pairs of one block with one other. ``weight``: ranks go by the score times it, rounded to nine digits; pairs too
    close to the middle between two such numbers are kept besides. ``also``: its scores, with the rest of the weight, are added,
    and the sum is the score."""
    items = items.take(pa.compute.sort_indices(items["id"]))
    a, b = _matrix(queries["vector"]), _matrix(items["vector"])
    qn, bn = _norms(a), _norms(b)
    unit = lambda m, n: m / np.where(n == 0, 1.0, n)[:, None]
    ua, ub = unit(a, qn), unit(b, bn)
    listed = "lists" in queries.column_names
    if listed:
        cells, cell = np.unique(items["list"].to_numpy(), return_inverse=True)
        wants = np.zeros((len(a), len(cells)), dtype=bool)
        asked = queries["lists"].combine_chunks()
        wanted = asked.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
        owner = np.repeat(np.arange(len(a)), pa.compute.list_value_length(asked).to_numpy(zero_copy_only=False))
        wants[owner[cells[at] == wanted], at[cells[at] == wanted]] = True
    besides = iter(also(items, queries)) if also else iter(())
    found = []
    step = len(b) if also else STEP_ITEMS
    for i in range(0, len(b), step):
        for q in range(0, len(a), STEP_QUERIES):
            columns = np.arange(i, min(i + step, len(b)))
            if listed:
                columns = columns[wants[q : q + STEP_QUERIES].any(axis=0)[cell[columns]]]
            if not len(columns):
                continue
            near = ua[q : q + STEP_QUERIES] @ ub[columns].T
            if also:
                extra = np.zeros(near.shape)
                for r, (at, value) in enumerate(islice(besides, len(near))):
                    extra[r, at] = value
                near += extra * ((1 - weight) / weight)
            near[np.isnan(near)] = np.inf
            if listed:
                near[~wants[q : q + STEP_QUERIES][:, cell[columns]]] = -np.inf
            floor = np.full(len(near), -np.inf if least is None else least - _ROOM)
            if k is not None and len(columns) > k:
                room = _ROOM if weight is None else 2e-9 / weight
                floor = np.maximum(floor, np.partition(near, len(columns) - k, axis=1)[:, len(columns) - k] - room)
            rows, hits = np.nonzero((near >= floor[:, None]) & (near > -np.inf))
            rows, hits = rows + q, columns[hits]
            size = qn[rows] * bn[hits]
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(size == 0, 0.0, _in_order(a, b, rows, hits) / size)
            if also:
                score = weight * score + (1 - weight) * extra[rows - q, hits]
            if least is not None:
                kept = score >= least
                rows, hits, score = rows[kept], hits[kept], score[kept]
            if k is not None:
                doubtful = np.zeros(len(rows), dtype=bool)
                by = np.where(np.isnan(score), np.inf, score)
                if weight is not None:
                    by = by * (1.0 if also else weight) * 1e9
                    doubtful = np.abs(by - np.floor(by) - 0.5) < 1e-4
                    by = np.rint(by)
                order = np.lexsort((hits, -by, rows))
                sure = order[~doubtful[order]]
                start = np.searchsorted(rows[sure], rows[sure], side="left")
                kept = np.concatenate([sure[np.arange(len(sure)) - start < k], np.flatnonzero(doubtful)])
                rows, hits, score = rows[kept], hits[kept], score[kept]
            found.append(pa.table({"qid": queries["qid"].take(rows), "id": items["id"].take(hits), "score": score}))
    return pa.concat_tables(found) if found else pa.table({"qid": queries["qid"].slice(0, 0), "id": items["id"].slice(0, 0), "score": pa.array([], pa.float64())})


def _blocks(n: int, most: int, wished: int) -> int:
    """How many blocks: enough for ``most`` rows each, more for parallel work, but none of few rows."""
    return max(1, -(-n // most), min(-(-n // (most // 16)), wished))


def scored(queries: DataFrame, items: DataFrame, k: int | None = None, least: float | None = None, weight: float | None = None, also: tuple[DataFrame, DataFrame, Scores] | None = None) -> DataFrame:
    """(qid, id, score): cosines of queries, (qid, vector), with items, (id, vector); one without length scores 0. With
    ``k``, of each query and block of items the best, ties by the smaller id, so that the best of all are among them; with
    ``least``, those of that score or more. Where queries have ``lists`` and items ``list`` and ``cell``, queries also
    ``cell``, a query meets only items of its cell and lists. With ``also``, which goes with ``k`` and ``weight``, the score is
    ``weight`` times the cosine and the rest of the weight times another score: more columns of queries, by qid, and of items,
    by id, and what scores a block by them. Vectors that are null, hold a null or have another length than the query's are left
    out. A task holds a block of each."""
    whole = "vector IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)"
    queries, items = queries.where(whole), items.where(whole)
    parallel = 2 * items.sparkSession.sparkContext.defaultParallelism
    parts = 0 if "cell" in items.columns else _blocks(items.count(), TEXTS if also else ITEMS, parallel)
    of = _blocks(queries.count(), QUERIES, parallel if parts == 1 else 1)
    if also:
        queries, items = queries.join(also[0], "qid", "left"), items.join(also[1].hint("merge"), "id", "left")
    scores = also[2] if also else None
    block = lambda df, by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if not parts:
        a, b = queries.withColumn("block", block(queries, "qid", of)), items.withColumn("block", every(of))
    else:
        a = queries.withColumn("block", block(queries, "qid", of)).withColumn("cell", every(parts))
        b = items.withColumn("cell", block(items, "id", parts)).withColumn("block", every(of))
    keys = ["cell", "block", "size"]
    a, b = (df.withColumn("size", F.size("vector")) for df in (a, b))
    schema = f"qid {dict(queries.dtypes)['qid']}, id {dict(items.dtypes)['id']}, score double"

    def pairs(theirs: pa.Table, mine: pa.Table) -> pa.Table:
        if not len(theirs) or not len(mine):
            theirs, mine = theirs.slice(0, 0), mine.slice(0, 0)
            return pa.table({"qid": mine["qid"], "id": theirs["id"], "score": pa.array([], pa.float64())})
        return _scored(theirs, mine, k, least, weight, scores)

    work: Callable[[pa.Table, pa.Table], pa.Table] = pairs
    return b.groupBy(*keys).cogroup(a.groupBy(*keys)).applyInArrow(work, schema)
