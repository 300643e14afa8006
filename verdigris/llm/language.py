"""Language identification by nearest centroids of TF-IDF vectors of byte n-grams.

A language has several centroids, so that registers of it that differ don't blur. A text takes the language of the centroid
with the largest cosine; one that is farther from every centroid than nearly all training texts is marked as rejected.
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

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
#: Documents whose vectors are held at once.
_ROWS = 256


@dataclass(frozen=True)
class Fit:
    """sample_rows bounds the training texts that centroids are clustered from, spread evenly over languages; document
    frequencies are counted over all training texts. sizes are the lengths of n-grams in bytes; dims a power of 2."""

    sample_rows: int = 2400
    dims: int = 4096
    sizes: tuple[int, ...] = (1, 2, 3, 4)
    clusters: int = 4
    passes: int = 12
    reject_share: float = 0.002


@dataclass(frozen=True)
class Model:
    fit: Fit
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    least: np.ndarray  # the cosine below which a centroid rejects


def _counts(data: np.ndarray, bounds: np.ndarray, fit: Fit) -> np.ndarray:
    """[document, dimension] counts of hashed n-grams; letters only, anything else is one blank."""
    rows = len(bounds) - 1
    folded = _FOLD[data].astype(np.uint32)
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 0x20) | (folded[:-1] != 0x20)
    kept = np.concatenate(([0], np.cumsum(keep)))
    folded, bounds = folded[keep], kept[bounds]
    row = np.repeat(np.arange(rows), np.diff(bounds))
    shift = np.uint32(32 - fit.dims.bit_length() + 1)
    out = np.zeros(rows * fit.dims, dtype=np.int64)
    key = np.zeros(len(folded), dtype=np.uint32)
    for n in range(1, max(fit.sizes) + 1):
        if len(folded) < n:
            break
        key = (key[: len(folded) - n + 1] << np.uint32(8)) | folded[n - 1 :] if n > 1 else folded.copy()
        if n in fit.sizes:
            inside = row[: len(key)] == row[n - 1 :]
            hashed = ((key[inside] ^ np.uint32(n * 0x9E3779)) * np.uint32(0x9E3779B1)) >> shift
            out += np.bincount(row[: len(key)][inside] * fit.dims + hashed, minlength=len(out))
    return out.reshape(rows, fit.dims)


def _groups(part: W.Slice) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for at in range(0, part.rows, _ROWS):
        to = min(part.rows, at + _ROWS)
        low, high = part.bounds[at], part.bounds[to]
        yield at, to, part.data[low:high], part.bounds[at : to + 1] - low


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _cluster(x: np.ndarray, k: int, passes: int) -> np.ndarray:
    """Spherical k-means; the seeds are each the text farthest from those before."""
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(passes):
        of = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[of == i].mean(axis=0) if (of == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def train(docs: DataFrame, fit: Fit = Fit(), text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id") -> Model:
    """Learn from all rows with a language and a text. order_col only decides, by its hash, which rows are sampled for the
    centroids. Without such rows the model knows no language."""
    usable = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(11), order_col).alias("draw"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(fit.dims + 1, dtype=np.int64)
        for batch in batches:
            for part in W.slices(batch.column(0)):
                for _, _, data, bounds in _groups(part):
                    total[:-1] += (_counts(data, bounds, fit) > 0).sum(axis=0)
                total[-1] += part.rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(fit.dims + 1)), pa.array(total)], ["dim", "n"])

    table = usable.select("text").mapInArrow(frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()  # dims + 1 rows
    df = np.zeros(fit.dims + 1)
    for r in table:
        df[r["dim"]] = r["n"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(fit.sample_rows).collect()}
    quota = max(1, fit.sample_rows // max(1, len(sizes)))
    drawn = (F.pmod("draw", F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, quota / v))]), F.col("lang")) if sizes else F.lit(False)
    picked = usable.where(drawn).orderBy("draw").limit(2 * fit.sample_rows)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column(0)):
                for at, to, data, bounds in _groups(part):
                    v = _vectors(_counts(data, bounds, fit), idf).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(part.first + at, to - at), pa.array([r.tobytes() for r in v], pa.binary())], ["lang", "vector"])

    rows = scratch.materialize(picked, "sample").select("text", "lang").mapInArrow(vectors, "lang string, vector binary").collect()
    languages: list[str] = []
    centroids: list[np.ndarray] = []
    least: list[float] = []
    for lang in sorted({r["lang"] for r in rows}):
        own_rows = sorted(bytes(r["vector"]) for r in rows if r["lang"] == lang)
        x = np.stack([np.frombuffer(v, np.float16) for v in own_rows]).astype(np.float32)
        c = _cluster(x, fit.clusters, fit.passes)
        near = x @ c.T
        of = near.argmax(axis=1)
        for i in range(len(c)):
            own = near[of == i, i]
            languages.append(lang)
            least.append(float(np.quantile(own, fit.reject_share)) if len(own) else 0.0)
        centroids.append(c)
    return Model(fit, idf, languages, np.concatenate(centroids) if centroids else np.zeros((0, fit.dims), np.float32), np.array(least))


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, lang_pred string, score double (the largest cosine, 0 to 1) and rejected boolean
    (farther from its centroid than nearly all of the texts that made it).

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text where the model knows no
    language. Whole texts are read. Kept columns named like one of the three are replaced; names that begin with ``__`` are
    reserved. Kept columns named like one of the three are replaced; names that begin with ``__`` are
    reserved.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score", "rejected")]
    plain = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    names = np.array(model.languages, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(keep))
            for part in W.slices(text):
                lettered = part.per_row(_ASCII_LETTER[part.data]) > 0
                for i in np.flatnonzero(~lettered & part.valid & (np.diff(part.bounds) > 0)):
                    lettered[i] = any(c.isalpha() for c in text[part.first + int(i)].as_py())
                for at, to, data, bounds in _groups(part):
                    cut = [batch.column(i).slice(part.first + at, to - at) for i in range(len(keep))]
                    if not len(names):
                        yield pa.RecordBatch.from_arrays([*cut, pa.array(["und"] * (to - at)), pa.array(np.zeros(to - at)), pa.array(np.ones(to - at, bool))], schema.names)
                        continue
                    near = _vectors(_counts(data, bounds, model.fit), model.idf) @ model.centroids.T
                    best = near.argmax(axis=1)
                    score = np.clip(near[np.arange(to - at), best], 0, 1).astype(float)
                    known = lettered[at:to]
                    yield pa.RecordBatch.from_arrays(
                        [*cut, pa.array(np.where(known, names[best], "und").tolist(), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(~known | (score < model.least[best]))], schema.names
                    )

    return plain.mapInArrow(run, schema)
