"""Toxicity by weak supervision.

Many voters (lexicons of mined words, patterns of mined word beginnings, absence of both, and the human label) vote on a
bounded sample of documents. A generative model with a latent class estimates each voter's accuracy, the human's as well,
and which voters depend on each other; its posterior probabilities are the labels that a linear classifier over the mined
terms is trained on. Scoring is one pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm import scratch
from verdigris.llm import words as W

#: Lengths in bytes of the word beginnings that patterns are made of; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6, 7, 8)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass(frozen=True)
class Fit:
    """sample_rows bounds the labelled rows used, chosen by a hash of their id; the sample is collected as counts of at
    most ``terms`` mined terms a row. least_rows: toxic rows in which a term occurs before it is mined."""

    sample_rows: int = 6000
    terms: int = 300
    least_rows: int = 4
    precise: float = 0.85
    lexicons: int = 12
    strength: float = 1.0
    passes: int = 25


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray  # ascending
    weights: np.ndarray
    intercept: float


def _terms(part: W.Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every word and word beginning; words are runs of letters, A-Z lower-cased."""
    spans = W.spans(_LETTER[part.data], part.bounds)
    hasher = W.SpanHasher(W.lower(part))
    for n in BEGINNINGS:
        if n == 0:
            yield spans.row, hasher(spans.start, spans.end)
        else:
            long = spans.end - spans.start >= n
            yield spans.row[long], hasher(spans.start[long], spans.start[long] + n) ^ np.uint64(n)


def _mine(sample: DataFrame, fit: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms whose presence speaks most clearly for label 1, clearest first, their lengths, and whether nearly all rows
    that have them are of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column(1))
            for part in W.slices(batch.column(0)):
                for n, (row, h) in zip(BEGINNINGS, _terms(part), strict=True):
                    order = np.lexsort((h, row))
                    row, h = row[order], h[order]
                    new = np.ones(len(h), dtype=bool)
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    value, back = np.unique(h[new], return_inverse=True)
                    of = label[part.first + row[new]]
                    yes = np.bincount(back[of == 1], minlength=len(value))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(value.view(np.int64)), pa.array(np.full(len(value), n)), pa.array(yes.astype(np.int64)), pa.array((np.bincount(back, minlength=len(value)) - yes).astype(np.int64))],
                        ["hash", "length", "yes", "no"],
                    )

    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(size) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    counted = sample.select("text", "label").mapInArrow(run, "hash long, length long, yes long, no long").groupBy("hash", "length").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    odds = F.log((F.col("yes") + 0.5) / (size[1] + 1)) - F.log((F.col("no") + 0.5) / (size[0] + 1))
    clear = odds / F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    top = counted.where(F.col("yes") >= fit.least_rows).withColumn("z", clear).where("z > 0").orderBy(F.desc("z"), "hash").limit(fit.terms).collect()
    precise = [r["yes"] >= fit.precise * (r["yes"] + r["no"]) for r in top]
    return np.array([r["hash"] for r in top], dtype=np.int64).view(np.uint64), np.array([r["length"] for r in top], dtype=np.int64), np.array(precise, dtype=bool)


def _count(part: W.Slice, ascending: np.ndarray) -> np.ndarray:
    """How often each of the terms occurs in each document of a slice."""
    out = np.zeros((part.rows, len(ascending)), dtype=np.float32)
    if not len(ascending):
        return out
    for row, h in _terms(part):
        at = np.minimum(np.searchsorted(ascending, h), len(ascending) - 1)
        hit = ascending[at] == h
        np.add.at(out, (row[hit], at[hit]), 1)
    return out


def _votes(counts: np.ndarray, length: np.ndarray, precise: np.ndarray, rank: np.ndarray, fit: Fit) -> np.ndarray:
    """A column a voter: 1 toxic, 0 not, -1 abstains."""
    word = length == 0
    columns = []
    for group in range(fit.lexicons):  # lexicons: the precise words, dealt out by rank
        own = word & precise & (rank % fit.lexicons == group)
        columns.append(np.where(counts[:, own].any(axis=1), 1, -1))
    for n in BEGINNINGS[1:]:  # patterns: a word that begins precisely as mined, or several that begin nearly so
        columns.append(np.where(counts[:, precise & (length == n)].any(axis=1), 1, -1))
        total = counts[:, length == n].sum(axis=1)
        columns += [np.where(total >= least, 1, -1) for least in (4, 12)]
    columns.append(np.where(counts[:, precise].any(axis=1), -1, 0))
    columns.append(np.where(counts.any(axis=1), -1, 0))
    columns.append(np.where(counts.sum(axis=1) <= 2, 0, -1))
    return np.column_stack(columns).astype(np.int64)


def _groups(related: np.ndarray, least: float = 0.4, most: int = 5) -> list[list[int]]:
    """Voters that depend on each other, from the most closely related pair on, in groups of at most ``most``; the last voter,
    the human, stays alone."""
    m = len(related)
    of, groups = list(range(m)), {i: [i] for i in range(m)}
    pairs = sorted(((related[i, j], i, j) for i in range(m - 1) for j in range(i) if related[i, j] >= least), reverse=True)
    for _, i, j in pairs:
        a, b = of[i], of[j]
        if a != b and len(groups[a]) + len(groups[b]) <= most:
            groups[a] += groups.pop(b)
            for k in groups[a]:
                of[k] = a
    return list(groups.values())


def label_model(votes: np.ndarray, annotator: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A latent-class model of voters that may abstain, fitted by expectation maximisation.

    votes: -1, 0 or 1 per document and voter. annotator: one more voter, who never abstains; the classes are first guessed
    from that, and its accuracy is estimated like any other's, from how it agrees with them. Returns the posterior of class
    1, each voter's probabilities [voter, class, vote + 1], and the voters' correlations beyond what the class explains.

    Voters that are related within the first guess of the classes vote as one group, whose patterns of votes have
    probabilities of their own; patterns that were seldom seen are drawn towards what independent voters would give. Were
    voters taken as independent at first, many copies of one would make the classes their own.
    """
    all_votes = np.column_stack([votes, annotator]) + 1
    n, m = all_votes.shape
    seen = np.stack([(all_votes == v) for v in range(3)], axis=2).astype(float)
    q = np.where(annotator == 1, 0.9, 0.1).astype(float)
    trust = np.full((m, 2, 3), 0.5)
    trust[-1] = [[1e-3, 4.5, 0.5], [1e-3, 0.5, 4.5]]
    theta, related = np.zeros((m, 2, 3)), np.zeros((m, m))
    groups: list[list[int]] | None = None
    patterns: list[tuple[np.ndarray, np.ndarray]] = []  # of each group: a document's pattern, and the patterns
    for step in range(passes):
        both = np.column_stack([1 - q, q])
        theta = np.einsum("nc,nmv->mcv", both, seen) + trust
        theta /= theta.sum(axis=2, keepdims=True)
        logs = np.repeat(np.log(np.maximum(both.mean(axis=0), 1e-9))[None], n, axis=0)
        if groups is None:
            fired = (all_votes != 0) * np.where(all_votes == 2, 1.0, -1.0)
            rest = fired - np.einsum("nc,mc->nm", both, theta[:, :, 2] - theta[:, :, 1])
            scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            related = rest.T @ rest / n / np.outer(scale, scale)
            np.fill_diagonal(related, 0.0)
            groups = _groups(related)
            patterns = [np.unique(all_votes[:, g], axis=0, return_inverse=True) for g in groups]
        for g, (kinds, back) in zip(groups, patterns, strict=True):
            back = back.reshape(-1)
            alone = np.prod([theta[v][:, kinds[:, i]] for i, v in enumerate(g)], axis=0)  # [class, pattern]
            counted = np.column_stack([np.bincount(back, weights=both[:, c], minlength=len(kinds)) for c in (0, 1)]).T
            joint = counted + 4 * alone / alone.sum(axis=1, keepdims=True)
            logs += np.log(joint / joint.sum(axis=1, keepdims=True))[:, back].T
        q = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
    return q, theta, related


def linear_classifier(x: np.ndarray, target: np.ndarray, strength: float, steps: int = 25) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on probabilities by Newton steps; the intercept isn't shrunk."""
    x = np.column_stack([x, np.ones(len(x))]).astype(float)
    shrink = np.full(x.shape[1], strength)
    shrink[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(shrink), x.T @ (p - target) + shrink * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``fit.sample_rows`` rows of ``labels`` (id, label 0 or 1; others are ignored) that docs has.

    Only the sampled ids and labels are sent to the executors. Without rows of both labels the model knows no terms and
    scores every text with the share of label 1.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    chosen = chosen.dropDuplicates(["__id"]).orderBy(F.xxhash64(F.lit(3), "__id"), "__id").limit(fit.sample_rows)
    chosen = scratch.materialize(chosen, "sampled")
    sample = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(F.col("__id").alias("id"), F.col(text_col).cast("string").alias("text"), F.col("__label").alias("label"))
    sample = scratch.materialize(sample, "sample")
    hashes, length, precise = _mine(sample, fit)
    order = np.argsort(hashes)
    ascending = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column(1)):
                counts = _count(part, ascending)
                cut = [batch.column(i).slice(part.first, part.rows) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*cut, pa.array([r.tobytes() for r in counts], pa.binary())], ["id", "label", "counts"])

    rows = sample.select("id", "text", "label").mapInArrow(run, f"id {sample.schema['id'].dataType.simpleString()}, label int, counts binary").orderBy("id").limit(fit.sample_rows).collect()
    if not len(hashes):
        share = sum(r["label"] for r in rows) / len(rows) if rows else 0.0
        return Model(ascending, np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    counts = np.array([np.frombuffer(r["counts"], dtype=np.float32) for r in rows])
    gold = np.array([r["label"] for r in rows])
    posterior, _, _ = label_model(_votes(counts, length[order], precise[order], order, fit), gold, fit.passes)
    weights, intercept = linear_classifier(np.log1p(counts), posterior, fit.strength)
    return Model(ascending, weights, intercept)


def score_toxicity(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Returns the columns ``keep`` of docs, without ``score_col``, and ``score_col`` double from 0 to 1, higher where label 1 is
    likelier.

    A null or empty text has the score of a text without any mined term. Rows are neither dropped nor merged.
    """
    keep = [c for c in keep if c != score_col]
    carried = [c for c in keep if c != text_col]
    plain = docs.select(*carried, F.col(text_col).cast("string").alias("__text"))
    text_type = docs.schema[text_col].dataType.simpleString()
    out = docs.select(*carried).schema.add("__text", "string").add(score_col, "double")
    with_text = text_col in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(carried))
            for part in W.slices(text):
                z = np.log1p(_count(part, model.hashes)) @ model.weights + model.intercept
                cut = [batch.column(i).slice(part.first, part.rows) for i in range(len(carried))]
                own = text.slice(part.first, part.rows) if with_text else pa.nulls(part.rows, pa.string())
                yield pa.RecordBatch.from_arrays([*cut, own, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], out.names)

    scored = plain.mapInArrow(run, out)
    return scored.select(*[F.col("__text").cast(text_type).alias(c) if c == text_col else F.col(c) for c in keep], score_col)


def learnable(id_col: str = "doc_id", folds: int = 5, held: int = 0) -> Column:
    """Rows that may be learnt from: crc32 of the id as text isn't ``held`` modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != held
