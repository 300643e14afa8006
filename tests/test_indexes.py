"""Set joins, vector and text indexes against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import entities, setjoin, textindex, vectorindex
from verdigris.plans import catalog
from verdigris.plans import retrieval as plans

SETS = "id long, items array<string>"


@pytest.mark.parametrize("least", [0.0, 0.3, 0.5, 0.75])
def test_similar_sets(spark, least):
    rng = random.Random(5)
    draw = lambda: sorted({rng.choice("aabbcdefghijklmnop") for _ in range(rng.randrange(0, 12))} | ({"z"} if rng.random() < 0.8 else set()))
    left, right = [(i, draw()) for i in range(60)] + [(60, None)], [(i, draw()) for i in range(150)] + [(150, None), (151, [])]
    want = {}
    for i, x in left:
        for j, y in right:
            if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) > least:
                want[i, j] = len(set(x) & set(y))
    a, b = spark.createDataFrame(left, SETS), spark.createDataFrame(right, SETS)
    for small, hot in ((1000, 1000), (0, 3)):
        got = setjoin.similar_sets(a, b, least, small, hot).collect()
        assert len(got) == len(want) and {(r["left_id"], r["right_id"]): r["shared"] for r in got} == want
    assert setjoin.similar_sets(a.limit(0), b, least).count() == setjoin.similar_sets(a, b.limit(0), least).count() == 0


@pytest.mark.parametrize("least", [0.0, 0.3, 0.75])
def test_best_sets(spark, monkeypatch, least):
    """Blocks of few sets: the most similar set of each, of equals the smallest id, as by comparing all."""
    monkeypatch.setattr(setjoin, "RIGHT", 40)
    monkeypatch.setattr(setjoin, "LEFT", 16)
    rng = random.Random(7)
    draw = lambda: sorted({rng.choice("aabbcdefghijklmnop") for _ in range(rng.randrange(0, 12))} | ({"z"} if rng.random() < 0.8 else set()))
    left, right = [(i, draw()) for i in range(60)] + [(60, None), (61, ["?"])], [(i // 2, draw()) for i in range(150)] + [(150, None), (151, [])]
    want = {}
    for i, x in left:
        alike = [(len(set(x) & set(y)) / len(set(x) | set(y)), -j) for j, y in right if x and y]
        if alike and max(alike)[0] > least:
            want[i] = (-max(alike)[1], max(alike)[0])
    a, b = spark.createDataFrame(left, SETS), spark.createDataFrame(right, SETS)
    got = setjoin.best_sets(a, b, least).collect()
    assert len(got) == len(want) > 5 and {r["left_id"]: (r["right_id"], r["similarity"]) for r in got} == want
    assert setjoin.best_sets(a.limit(0), b, least).count() == setjoin.best_sets(a, b.limit(0), least).count() == 0


@pytest.mark.parametrize("least", [0.0, 0.3, 0.75])
def test_close_sets(spark, monkeypatch, least):
    """Blocks of few sets: all pairs that the join of prefixes finds, each once."""
    monkeypatch.setattr(setjoin, "RIGHT_ALL", 40)
    monkeypatch.setattr(setjoin, "LEFT_ALL", 16)
    rng = random.Random(8)
    draw = lambda: sorted({rng.choice("aabbcdefghijklmnop") for _ in range(rng.randrange(0, 12))} | ({"z"} if rng.random() < 0.8 else set()))
    a = spark.createDataFrame([(i, draw()) for i in range(60)] + [(60, None), (61, ["?"])], SETS)
    b = spark.createDataFrame([(i, draw()) for i in range(150)] + [(150, None), (151, [])], SETS)
    want = {(r["left_id"], r["right_id"], r["similarity"]) for r in setjoin.similar_sets(a, b, least).collect()}
    got = setjoin.close_sets(a, b, least).collect()
    assert len(got) == len(want) > 20 and {tuple(r) for r in got} == want
    assert setjoin.close_sets(a.limit(0), b, least).count() == setjoin.close_sets(a, b.limit(0), least).count() == 0


def test_every_question_is_resolved(spark):
    """Each live part's ticker or plain name, asked by the part itself, has an answer, not only those of some keys."""
    folder = "/root/testdata/sf0.001"
    asked = spark.read.parquet(f"{folder}/part.parquet").where("p_size > 5 AND p_partkey % 3 != 0").select("p_partkey").collect()
    found = {r["qid"] for r in catalog.queries()["entity_resolve_batch"](spark, folder).collect()}
    assert len(asked) > 100 and {r[0] for r in asked} <= found


def test_every_name_is_compared(spark):
    """Each part's plain name, asked by the part itself, is similar to its name, not only those of some keys."""
    folder = "/root/testdata/sf0.001"
    asked = spark.read.parquet(f"{folder}/part.parquet").where("p_partkey % 3 = 2").select("p_partkey").collect()
    found = {r["qid"] for r in catalog.queries()["join_theta_trigram"](spark, folder).where("qid = eid").collect()}
    assert len(asked) > 50 and {r[0] for r in asked} <= found


def test_trigram_pairs(spark):
    q = spark.createDataFrame([(1, "Acme Corp"), (2, "acme corp"), (3, None), (4, ""), (5, "Acme Corp")], "qid long, query string")
    n = spark.createDataFrame([(1, "acme corporation"), (1, "Acme Corp"), (2, "Zeta"), (3, None), (4, "")], "eid long, name string")
    got = {(r["qid"], r["eid"], round(r["similarity"], 6)) for r in entities.trigram_pairs(q, n, 0.3).collect()}
    assert {(i, e) for i, e, _ in got} == {(i, 1) for i in (1, 2, 5)} and (1, 1, 1.0) in got


def unit(rng, center, spread):
    v = center + spread * rng.normal(size=len(center))
    return v / np.linalg.norm(v)


@pytest.fixture(scope="module")
def cloud(spark):
    """Vectors round thirty centres, a third of all copies of one, and odd ones."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    rows = [(i, unit(rng, centers[i % 30], 0.25).tolist()) for i in range(1500)] + [(1500 + i, centers[0].tolist()) for i in range(700)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [1.0]), (5003, [None] * 16)]
    items = spark.createDataFrame(rows + odd, "id long, vector array<double>").repartition(4).cache()
    asked = [(i, unit(rng, centers[i % 30], 0.3).tolist()) for i in range(60)] + [(100, None), (101, [0.0] * 16), (102, centers[0].tolist())]
    index = vectorindex.build(items, lists=24, part_rows=200)
    yield rows, asked, index, spark.createDataFrame(asked, "qid long, vector array<double>")
    index.drop()


def cosines(rows, vector):
    m = np.array([v for _, v in rows])
    return m @ np.array(vector) / np.linalg.norm(m, axis=1) / np.linalg.norm(vector)


def test_vector_index(spark, cloud):
    rows, asked, index, queries = cloud
    assert index.entries.count() == len(rows) and index.lists.agg(F.sum("n")).first()[0] == len(rows)
    assert index.lists.agg(F.max("parts")).first()[0] > 1  # the copies are dealt out
    live = [(q, v) for q, v in asked if v and any(v)]
    within = {(r["qid"], r["id"]) for r in vectorindex.within(index, queries, 0.8).collect()}
    want = {(q, rows[j][0]) for q, v in live for j in np.flatnonzero(cosines(rows, v) >= 0.8)}
    assert want - within == within - want == set() and want
    best = {}
    for q, v in live:
        score = np.round(cosines(rows, v), 12)
        best[q] = [rows[j][0] for j in sorted(range(len(rows)), key=lambda j: (-score[j], rows[j][0]))[:10]]
    near = vectorindex.nearest(index, queries, 10, probes=4).withColumn("score", F.round("score", 12)).collect()
    got = {q: {r["id"] for r in near if r["qid"] == q} for q in best}
    recall = sum(len(set(best[q]) & got[q]) for q in best if q != 102) / (10 * (len(best) - 1))
    assert recall >= 0.9 and set(got) == set(best)
    exact = vectorindex.nearest(index, queries, 10, probes=1, exact=True).collect()
    scores = {q: sorted((round(r["score"], 9) for r in exact if r["qid"] == q), reverse=True) for q in best}
    assert scores == {q: [round(float(x), 9) for x in sorted(cosines(rows, v), reverse=True)[:10]] for q, v in live}
    plan = vectorindex.nearest(index, queries, 10, probes=4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(index.table) <= 1  # one scan of the entries


def test_empty_vector_index(spark):
    index = vectorindex.build(spark.createDataFrame([(1, None)], "id long, vector array<double>"))
    q = spark.createDataFrame([(1, [1.0])], "qid long, vector array<double>")
    assert vectorindex.within(index, q, 0.1).count() == vectorindex.nearest(index, q, 3, 2, exact=True).count() == 0
    index.drop()


def test_recall_on_the_table(spark):
    """Recall at 10 against the exact query, a few lists probed."""
    folder = "/root/testdata/sf0.01"
    index = plans.vector_index(spark, folder)
    near = vectorindex.nearest(index, plans.query_vectors(spark, folder), 11, probes=max(1, index.lists.count() * 2 // 3)).where("qid <> id")
    exact = plans.topk_vector(spark, folder)
    hit = exact.join(near.select("qid", "id"), ["qid", "id"], "left_semi").count()
    assert hit >= 0.9 * exact.count()


def words_of(text):
    return re.sub(r"[^\w\s]|_", "", text or "").lower().split()


def bm25(docs, query, limit):
    """(id, score) of all documents with every word, the best first, ties by id."""
    split = {i: words_of(t) for i, t in docs}
    split = {i: w for i, w in split.items() if w}
    mean = sum(map(len, split.values())) / max(1, len(split))
    asked = set(words_of(query))
    out = []
    for i, w in split.items():
        if asked and asked <= set(w):
            score = 0.0
            for x in asked:
                df = sum(x in v for v in split.values())
                tf = w.count(x)
                score += math.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            out.append((i, score))
    return sorted(out, key=lambda r: (-round(r[1], 9), r[0]))[:limit]


def test_text_index(spark):
    rng = random.Random(9)
    vocabulary = ["the"] * 30 + ["of"] * 12 + ["alpha", "Beta", "gamma,", "delta.", "eps-ilon"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(300)] + [(300, None), (301, ""), (302, "?!"), (303, "the " * 20_000)]
    asked = [(1, "the"), (2, "the of"), (3, "alpha beta"), (4, "gamma the delta"), (5, "unknown the"), (6, None), (7, " "), (8, "epsilon of THE the")]
    index = textindex.build(spark.createDataFrame(docs, "id long, text string").withColumn("word", F.lit("x")))
    queries = spark.createDataFrame(asked, "qid long, text string")
    some = spark.createDataFrame([(i,) for i in range(0, 303, 2)], "id long")
    for limit in (None, 1, 5, 1000):
        for items in (None, some):
            got = textindex.search(index, queries, limit, items).collect()
            for q, text in asked:
                want = [r for r in bm25(docs, text, None) if items is None or r[0] % 2 == 0 and r[0] < 303][:limit]
                mine = sorted(((r["id"], r["score"]) for r in got if r["qid"] == q), key=lambda r: (-round(r[1], 9), r[0]))
                assert [i for i, _ in mine] == [i for i, _ in want] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(mine, want, strict=True))
    assert textindex.search(index, queries.limit(0), 5).count() == 0
    empty = textindex.build(spark.createDataFrame([], "id long, text string"))
    assert textindex.search(empty, queries, 5).count() == 0
    index.drop(), empty.drop()
