"""Queries' steps on copies and in bounded memory: nothing is expanded that only the best are wanted of."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from verdigris.functions import screen, similarity
from verdigris.operators import chunking, entities, nearest, retrieval, setjoin, textindex, toolcalls
from verdigris.plans import catalog
from verdigris.sources import shared


def test_resolve_without_pairs_of_copies(spark, monkeypatch):
    """Many copies of a name and of a query: one row a query, the smallest eid, and no pairs of copies on the way."""
    monkeypatch.setattr(entities, "trigram_pairs", None)
    n = spark.range(3000).withColumn("name", F.when(F.col("id") % 3 == 0, "acme corporation").when(F.col("id") % 3 == 1, "zeta holdings").otherwise("acme korporation"))
    live = n.select((F.col("id") + 5).alias("eid"), "name", F.concat(F.lit("T"), "id").alias("ticker"), F.lit(None).cast("string").alias("ric"), (F.col("id") > 2).alias("active"))
    asked = ["Acme Corporatin", "zeta holding", "T7", "acme korporation", "no such thing", None]
    q = spark.range(1200).select(F.col("id").alias("qid"), F.get(F.array(*map(F.lit, asked)), (F.col("id") % 6).cast("int")).alias("query"))
    got = entities.resolve(q, live, live.select("eid", F.col("name").alias("alias"))).groupBy(F.col("qid") % 6, "eid", "tier").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 8, 4, 200), (1, 9, 4, 200), (2, 12, 2, 200), (3, 10, 1, 200)]


def test_nearest_in_blocks(spark, monkeypatch):
    """Blocks of few rows, many equal vectors, odd ones: the same rows as comparing all, and no more than k of a block."""
    monkeypatch.setattr(nearest, "STEP_ITEMS", 64)
    monkeypatch.setattr(nearest, "STEP_QUERIES", 8)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(1000 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(200)]
    odd = [(5000, None), (5001, [0.0] * 6), (5002, [1.0]), (5003, [None] * 6)]
    asked = [(i, v) for i, v in rows if i % 20 == 0] + [(7000, None), (7001, [0.0] * 6), (7002, [])]
    items, queries = spark.createDataFrame(rows + odd, "id long, vector array<double>"), spark.createDataFrame(asked, "qid long, vector array<double>")
    got = {(r["qid"], r["rank"]): (r["id"], round(r["score"], 12)) for r in retrieval.nearest(queries, items, 7).collect()}
    for q, v in asked:
        if not v:
            assert (q, 1) not in got
            continue
        cosine = lambda w: 0.0 if not any(v) or not any(w) else float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))  # noqa: E731, B023
        want = sorted(((-round(cosine(w), 12), i) for i, w in [*rows, odd[1]]))[:7]
        assert [got[q, r + 1] for r in range(7)] == [(i, -s + 0.0) for s, i in want]
    assert nearest.scored(queries, items, 7).count() <= 7 * 28 * 8  # seven of each of eight steps at most


def test_search_writes_no_candidates(spark, monkeypatch):
    """With a limit, the candidates of a query stay in their block: none are written, also where all texts hold its words."""
    index = textindex.build(spark.range(5000).select("id", F.concat(F.lit("the same w"), F.col("id") % 7).alias("text")))
    names = []
    monkeypatch.setattr(textindex, "written", lambda df, name: names.append(name) or shared.written(df, name))
    queries = spark.createDataFrame([(1, "the same"), (2, "w3 the"), (3, "w9 the")], "qid long, text string")
    got = sorted((r["qid"], r["id"]) for r in textindex.search(index, queries, 3).collect())
    index.drop()
    assert got == [(1, 0), (1, 1), (1, 2), (2, 3), (2, 10), (2, 17)] and "candidates" not in names


def test_chunks_in_bounded_batches():
    """Long texts in one batch: their chunks go back in batches of little more than ``CHARS`` characters, none lost."""
    texts = [" ".join(f"w{i}x{j}" for j in range(40_000)) for i in range(12)] + [None, "", "short"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
    cut = lambda cell, _: enumerate(chunking.split_text(cell.as_py() or "", 1000, 200, 100))
    out = list(chunking._in_pieces(iter([batch]), 1, (pa.int32(), pa.string()), ["id", "chunk_no", "chunk"], cut))
    sizes = [sum(map(len, b["chunk"].to_pylist())) for b in out]
    assert len(out) > 3 and max(sizes) < chunking.CHARS + 1000
    rows = [(i, n, c) for b in out for i, n, c in zip(*(b[k].to_pylist() for k in range(3)), strict=True)]
    assert rows == [(i, n, c) for i, t in enumerate(texts) for n, c in enumerate(chunking.split_text(t or "", 1000, 200, 100))]


def test_scan_finds_what_the_index_finds(spark, monkeypatch):
    """Without an index nothing of the texts is written or bucketed, and the same is found, by words and by stems."""
    rows = [(i, " ".join(w for j, w in enumerate(["The", "trading,", "trades", "trade", "of", "oil", "zinc"]) if (i >> j) & 1) + " pad" * (i % 5)) for i in range(128)]
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (502, "?!"), (503, "the oil " * 5000)], "id long, text string")
    asked = [(1, "the oil"), (2, "traded zinc"), (3, "trades of oil"), (4, "unknown oil"), (5, None), (6, "the"), (7, "zinc ZINC")]
    queries = spark.createDataFrame(asked, "qid long, text string")
    built = {english: textindex.build(docs, english=english) for english in (False, True)}
    want = {e: {(r["qid"], r["id"]): round(r["score"], 9) for r in textindex.search(i, queries).collect()} for e, i in built.items()}
    monkeypatch.setattr(textindex, "build", None)
    for english, index in built.items():
        got = textindex.scan(docs, queries, english=english).collect()
        assert {(r["qid"], r["id"]): round(r["score"], 9) for r in got} == want[english] and len(got) == len(want[english]) > 50
        assert textindex.scan(docs.limit(0), queries, english=english).count() == 0 == textindex.scan(docs, queries.limit(0), english=english).count()
        index.drop()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_question_is_put_together_once(spark):
    """The plan has a question's parts once, however many phrases are looked for, and the parts don't stay in a file's few tasks."""
    df = spark.createDataFrame([("top 5 tech", "in Japan"), (None, None)], "a string, b string").select(screen.build(F.concat_ws(" ~ ", "a", "b")).alias("s"))
    assert _plan(df).count("concat_ws( ~ ") == 1
    assert [r["s"] for r in df.collect()] == [f"SCREEN({screen.UNIVERSE},TR.HQCountryCode=JP,IN(TR.TRBCEconSectorCode,57),TOP(TR.CompanyMarketCap,5,nnumber),CURN=USD)", None]
    assert "RepartitionByExpression [p_partkey" in _plan(catalog.queries()["screen_build"](spark, "/root/testdata/sf0.001"))


def test_runs_of_words_by_one_pattern(spark):
    """Runs of words are those of a plain loop, also in odd texts, and nothing is worked out for each word by itself."""
    texts = ["a b c d", "A  b\tc\nA b c a b", "", " \n ", "one", None, "x\u00a0y z \u3000 $1 \\s (? [", "w" * 100_000, "é É \u2028 b", "a b " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for n in (1, 2, 3, 5):
        made = df.select("i", similarity.word_ngrams(similarity.tokens(F.col("t")), n).alias("runs"), similarity.tokens(F.col("t")).alias("w"))
        assert "lambda" not in _plan(made)
        for r in made.collect():
            w = r["w"]
            assert r["runs"] == (None if w is None else list(dict.fromkeys(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)))), (r["i"], n)


def test_numbers_are_read_once_a_token(spark):
    """Comparing two tokens reads no numbers, and lines of calls don't stay in a file's few tasks."""
    assert "CAST" not in str(toolcalls._near(F.col("a"), F.col("b"))).upper()
    assert "RepartitionByExpression [l_orderkey" in _plan(catalog.queries()["args_diff"](spark, "/root/testdata/sf0.001"))


def test_pairs_of_copies_are_made_last(spark):
    """All pairs of copies of similar names: different texts are compared and rounded once, by more tasks than one, and copies
    stay in lists of bounded length until the last step."""
    words = ["acme corporation", "Acme corporation ltd", "zeta holdings", "acme korporation", None, ""]
    n = [(None if i == 7 else i, words[i % 6] if i < 60 else words[0]) for i in range(4000)] + [(1, "acme corp")] * 3
    q = [(i, ["acme corporatin", "zeta holding", "no such thing", None, "acme corporation"][i % 5]) for i in range(200)]
    grams = lambda t: {f"  {w} "[i : i + 3] for w in t.lower().split() for i in range(len(w) + 1)}
    alike = {(a, b): len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a in {t for _, t in q if t} for b in {t for _, t in n if t}}
    want = sorted((i, -1 if e is None else e, round(alike[a, b], 3)) for i, a in q for e, b in n if a and b and alike[a, b] > 0.3)
    queries, names = spark.createDataFrame(q, "qid long, query string"), spark.createDataFrame(n, "eid long, name string")
    got = entities.trigram_pairs(queries, names, 0.3, 3)
    assert sorted((r["qid"], -1 if r["eid"] is None else r["eid"], r["similarity"]) for r in got.collect()) == want
    assert len(want) > 300_000 and got.rdd.getNumPartitions() > 1
    lists = entities._lists(names.where("name IS NOT NULL"), "name", "eid", 64)
    sizes = [r["k"] for r in lists.select(F.size("ids").alias("k")).collect()]
    assert sum(sizes) == sum(t is not None for _, t in n) and max(sizes) < 128
    assert "round(" not in _plan(catalog.queries()["join_theta_trigram"](spark, "/root/testdata/sf0.001"))
    assert setjoin.similar_sets(spark.createDataFrame([(1, ["a", "b"])], "id long, items array<string>"), spark.createDataFrame([(i, ["a", "b"]) for i in range(200)], "id long, items array<string>"), 0.3).rdd.getNumPartitions() > 1


def test_texts_stay_one_row(spark, monkeypatch):
    """The index has a row a text, not a row a word, and a search puts no row a word through a shuffle; the same is found where
    texts are counted few at a time and asked words are too many to be sent to all tasks."""
    docs = spark.range(300).select("id", F.concat_ws(" ", F.lit("the the"), *[F.concat(F.lit(f"w{k}x"), F.col("id") % (k + 2)) for k in range(40)]).alias("text"))
    queries = spark.createDataFrame([(1, "the"), (2, "w1x2 the w5x3"), (3, "w0x1 unknown"), (4, None), (5, "w38x39 w3x4")], "qid long, text string")
    found = []
    for words, small in ((2_000_000, 1_000_000), (100, 0)):
        monkeypatch.setattr(textindex, "WORDS", words)
        monkeypatch.setattr(textindex, "SMALL", small)
        index = textindex.build(docs)
        table = spark.table(index.table)
        assert table.count() == 300 == index.texts and table.selectExpr("sum(aggregate(tfs, 0, (s, x) -> s + x))").first()[0] == 300 * 42
        assert index.asked(queries)[1].count() == 300
        got = textindex.search(index, queries, 7)
        assert small == 0 or "Generate explode(words" not in _plan(got)
        found.append(sorted((r["qid"], r["id"], round(r["score"], 9)) for r in got.collect()))
        every = {(r["qid"], r["id"]) for r in textindex.search(index, queries).collect()}
        assert every == {(1, i) for i in range(300)} | {(2, i) for i in range(300) if i % 3 == 2 and i % 7 == 3} | {(5, i) for i in range(300) if i % 40 == 39 and i % 5 == 4}
        index.drop()
    assert found[0] == found[1] and [(q, i) for q, i, _ in found[0]][:7] == [(1, i) for i in range(7)] and len(found[0]) == 7 * 3


def test_children_are_scored_in_blocks(spark, monkeypatch):
    """Vectors and words are added up within a block: no search for all matches, and the same parents and children as by one, also
    for queries without words, unknown words, odd vectors, and copies that all match."""
    monkeypatch.setattr(nearest, "TEXTS", 64)
    monkeypatch.setattr(nearest, "STEP_QUERIES", 4)
    rng = np.random.default_rng(6)
    vectors = {i: [float(x) for x in rng.normal(size=5)] for i in range(240)} | {i: [1.0, 0.0, 2.0, 0.0, 1.0] for i in range(300, 360)} | {400: None, 401: [0.0] * 5, 402: [1.0], 403: [None] * 5}
    rows = [(i, i // 10 if i % 17 else None, v, f"the w{i % 4} x{i % 9} " + "pad " * (i % 5) if i % 6 else None) for i, v in vectors.items()]
    children = spark.createDataFrame(rows, "id long, parent long, vector array<double>, text string")
    asked = [(q, vectors[q], f"w{q % 4} the") for q in range(0, 60, 4)] + [(300, vectors[300], "the"), (400, None, "the"), (401, [0.0] * 5, "x1 the"), (402, vectors[3], None), (403, vectors[4], "unknown the"), (404, vectors[5], "x5")]
    queries = spark.createDataFrame(asked, "qid long, vector array<double>, text string")
    index, search = textindex.build(children.select("id", "text")), textindex.search
    seen = lambda words, least: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in retrieval.small_to_big(queries, children, words, 4, 12, least).select("qid", "rank", "id", "is_parent", "matched", "score").collect())
    want = seen(lambda q, limit, items: search(index, q, limit, items), 0.6)
    monkeypatch.setattr(textindex, "search", None)
    assert seen(index, 0.6) == want and len(want) > 60 and {r[3] for r in want} == {True, False}
    assert retrieval._by_both(queries, children.select("id", "vector").where("id < 300"), index, 12, 0.7).count() < 21 * 12 * 12
    index.drop()
