"""The models that learn: label model, clashing columns, signals of lines, and predictions of languages."""

import numpy as np
from pyspark.sql import functions as F

from verdigris.llm import language, quality, toxicity


def simulated(rng, n=4000, share=0.15):
    """Votes of six independent voters and of five that copy one, and a human who errs in a fifth of the cases."""
    y = (rng.random(n) < share).astype(int)
    voters = [np.where(rng.random(n) < cover, np.where(rng.random(n) < right, y, 1 - y), -1) for cover, right in ((0.9, 0.85), (0.8, 0.9), (0.9, 0.8), (0.7, 0.85), (0.9, 0.8), (0.8, 0.85))]
    weak = np.where(rng.random(n) < 0.6, y, 1 - y)
    copies = [np.where(rng.random(n) < 0.97, weak, 1 - weak) for _ in range(5)]
    human = np.where(rng.random(n) < 0.2, 1 - y, y)
    return y, np.column_stack([*voters, *copies]), human


def test_label_model_finds_accuracies_and_related_voters():
    y, votes, human = simulated(np.random.default_rng(4))
    q, theta, related = toxicity.label_model(votes, human, 30)
    right = ((q >= 0.5) == (y == 1)).mean()
    assert right > 0.95 > (human == y).mean() + 0.1
    assert abs(theta[-1, 1, 2] - 0.8) < 0.1 and abs(theta[-1, 0, 1] - 0.8) < 0.1  # the human's own accuracy
    groups = toxicity._groups(related)
    assert sorted(range(6, 11)) in [sorted(g) for g in groups] and [len(votes[0])] in groups
    half = (votes[:, 6:].mean(axis=1) > 0.5) != ((votes[:, :6] == 1).sum(axis=1) > 3)
    assert half.any() and ((q[half] >= 0.5) == (y[half] == 1)).mean() > 0.8  # five copies don't outvote six voters


def test_columns_that_clash(spark):
    rows = [(i, ("you stupid idiot clown " if i % 3 == 0 else "a kind and quiet day ") * 20, "x", 1, "y", "z") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, id int, __label string, n string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 != 0), "q") for i in range(60)], "doc_id long, toxic int, quality int, label string")
    model = toxicity.fit_toxicity(docs.drop("__label"), labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model, ["doc_id", "label"]).collect()}
    assert all((scored[i] >= 0.5) == (i % 3 == 0) for i in range(60))
    field = quality.train(docs.drop("__label"), labels)
    assert quality.rate(docs, field).count() == 60


def test_lines_that_documents_share_are_boilerplate(spark):
    """Good documents end in a notice after lines of their own; copies of a document share all lines, and keep them."""
    own = lambda i: "\n".join(" ".join(f"{w}{chr(97 + i)}{chr(97 + k)}word" for k in range(10)) + "." for w in "abcdefg")
    rows = [(i, own(i // 4) + "\nAll rights reserved by the publisher.\nAccept") for i in range(80)] + [(100 + i, "### $$$ 1 2 3\n>>> <<<") for i in range(40)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {}
    for part in __import__("verdigris.llm.words", fromlist=["slices"]).slices(__import__("pyarrow").array([t for _, t in rows])):
        m = quality.measure(part)
        for (i, t), a, b in zip(rows, m.bounds[:-1], m.bounds[1:], strict=True):
            for line, h in zip([x for x in (t or "").split("\n") if x.strip()], m.line_hashes[a:b].tolist(), strict=True):
                hashes[line] = h
    spread = quality._spread(docs, "text", np.unique(np.array(list(hashes.values()), dtype=np.uint64)))
    at = lambda line: spread[int(np.uint64(hashes[line]).view(np.int64))]
    assert at("All rights reserved by the publisher.") == 20 and at(own(3).split("\n")[2]) == 1 and at("Accept") == 1
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, quality int")
    field = quality.train(docs, labels)
    kept = {r["doc_id"]: r["kept"] for r in quality.rate(docs, field).collect()}
    assert all(kept[i] for i in range(80)) and not any(kept[i] for i in range(100, 140)) and not kept[200] and not kept[201]
    assert quality.train(docs, labels, quality.Fit(sample_lines=5)).emission.shape == field.emission.shape


def test_long_text_of_lines():
    import pyarrow as pa

    from verdigris.llm import words

    text = "a line of words here.\n" * 60_000
    (part,) = words.slices(pa.array([text]))
    m = quality.measure(part)
    assert m.n_dup_lines[0] == 59_999 and len(m.line_words) == 60_000


def test_language_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model, ["doc_id"]).collect()}
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs.repartition(7), model, ["doc_id"]).collect()}
    assert len(got) == docs.count() and all(again[i][0] == lang and abs(again[i][1] - score) < 1e-5 for i, (lang, score) in got.items())
    truth = {r["doc_id"]: r["lang"] for r in docs.where(F.length("text") > 200).collect()}
    assert np.mean([got[i][0] == lang for i, lang in truth.items() if lang]) > 0.95
