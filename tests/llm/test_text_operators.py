import random
import re
from collections import Counter

import pyarrow as pa

from verdigris.llm import html_text, language, quality, toxicity
from verdigris.llm import words as W


def test_words_and_windows_against_python():
    rng = random.Random(2)
    texts = ["", None, " a\tb\u00a0c\x0bd ", "Ä ö ü", "x" * 5000] + ["".join(rng.choice("ab \n\té.") for _ in range(rng.randrange(60))) for _ in range(200)]
    for limit in (7, 1 << 20):
        seen = 0
        for part in W.slices(pa.array(texts), limit):
            w = W.words(part)
            h = W.span_hashes(part.data, w.start, w.end)
            hw, hb = W.windows(h, w.bounds, 3, short=True)
            for i in range(part.rows):
                text = texts[part.first + i]
                want = re.findall(r"[^\x20\x09-\x0D]+", text or "")
                got = [bytes(part.data[a:b]).decode() for a, b in zip(w.start[w.bounds[i] : w.bounds[i + 1]], w.end[w.bounds[i] : w.bounds[i + 1]], strict=True)]
                assert got == want
                runs = [tuple(want[k : k + 3]) for k in range(len(want) - 2)] if len(want) >= 3 else [tuple(want)] * bool(want)
                mine = hw[hb[i] : hb[i + 1]].tolist()
                assert len(mine) == len(runs) and len(set(mine)) == len(set(runs))
                seen += 1
        assert seen == len(texts)


def base_metrics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_base_metrics(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a\na\n a\na\n", "é ü é ü é ü é ü", "# *$ x|y <b>"] + ["".join(rng.choice(["a ", "b ", "\n", "é", "# ", "c d "]) for _ in range(rng.randrange(200))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "text AS kept", "1 AS n_words")
    field = quality.train(df, spark.createDataFrame([], "doc_id long, quality int"))
    for r in quality.rate(df, field).collect():
        want = base_metrics(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_quality_field_learns_and_decodes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    held = quality.rate(docs, field).join(labels.where("doc_id % 3 = 0"), "doc_id").where("NOT base_failed").collect()
    good = [r["kept"] for r in held if r["quality"] == 1]
    bad = [r["kept"] for r in held if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    sizes = [0, 1, 5, 3, 7]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    scores, transition = rng.normal(size=(bounds[-1], 2)), rng.normal(size=(2, 2))
    got = quality.viterbi(scores, transition, bounds)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        paths = itertools.product((0, 1), repeat=int(b - a))
        best = max(paths, key=lambda p: sum(scores[a + i, s] for i, s in enumerate(p)) + sum(transition[p[i], p[i + 1]] for i in range(len(p) - 1)))
        assert tuple(got[a:b]) == best


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = "crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2"
    model = language.train(docs.where(f"NOT {held}"))
    rows = language.predict(docs.where(held), model, ["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 …"), (4, "é"), (5, "日本語")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(odd, model, ["doc_id"]).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] in {"en", "de", "fr", "es"} and got[5] != "und"
    none = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(odd, none, ["doc_id"]).collect()} == {"und"}


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels.where(toxicity.learnable()))
    rows = toxicity.score_toxicity(docs, model, ["doc_id"]).join(labels.where(~toxicity.learnable()), "doc_id").collect()
    toxic, clean = [r["score"] >= 0.5 for r in rows if r["toxic"] == 1], [r["score"] >= 0.5 for r in rows if r["toxic"] == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    odd = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (None, "x", None)], "doc_id long, text string, score string").drop("score")
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score_toxicity(odd, model, ["doc_id", "text"]).collect())
    empty = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(odd, empty, ["doc_id"]).count() == 3


def test_html(spark):
    page = (
        "<html><head><title>T</title><style>.x, #y{display:none}</style><body><h1>Hi &amp; bye</h1><p>One\n two<p>Three<br>four<div class=x>no</div>"
        "<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul><table><caption>Cap</caption><tr><th>Name<th>Age<tr><td>Bo<td>12<tr><td>Alexandra<br>Z<td>3</table>tail <b>bo</b>ld"
        "<span style='display:none'>zz</span><pre>a  b\n  c</pre><!-- c --><p hidden>h</p><script>if (a</b>) x</script>end < 3 <unclosed"
    )
    assert html_text.render(page) == (
        "Hi & bye\n\nOne two\n\nThree\nfour\n\n- a\n- b\n 3. c\n 4. d\n- e\n\nCap\nName       Age\nBo         12\nAlexandra  3\nZ\n\ntail bold\n\na  b\n  c\n\nend < 3 <unclosed"
    )
    assert html_text.render(None) == html_text.render("") == html_text.render("<p></p><!-- x") == ""
    assert html_text.render("<div>" * 20000 + "deep") == "deep"
    assert html_text.render("<a b='" * 3000).count("<") == 3000
    df = spark.createDataFrame([(1, page, "old"), (2, None, "old"), (3, "", None)], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert got[1].startswith("Hi & bye") and got[2] is None and got[3] == ""
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_html_cells_without_table():
    assert html_text.render("<p>a</p><td>b</td><th>c</th> d<caption>e</caption>") == "a\n\nbc de"
    assert html_text.render("<table><tr><td>a</table></table><td>b<td>c<p>d") == "a\n\nbc\n\nd"
    assert html_text.render("<td>x<table><tr><td>y<td>z</table>w") == "x\n\ny  z\n\nw"
    assert html_text.render("<table><td>a<td><b>b</td></table><div><td>c</div>") == "a  b\n\nc"


def test_html_style_sheets_spans_and_depth():
    sheet = "<style>/* .x{} */ @media print {.x{display:none}} .y{display:none} .y{display:block} p.z{visibility:hidden} #k{display:none!important} em b{display:none}</style>"
    body = "<p class=x>X<p class=y>Y<p class=z>Z<div class=z>W</div><p id=k style='display:block'>K<p hidden>H<p style='visibility:hidden'>A<b style='visibility:visible'>B</b>"
    assert html_text.render(sheet + body).split() == ["X", "Y", "W", "B"]
    table = "<table><tr><th colspan=2>Name and age<th>City<tr><td>Al<td>3<td>Rome<tr><td rowspan=2>Bo<td>4<td>Oslo<tr><td>5<td>Bern</table>"
    assert html_text.render(table).split("\n") == ["Name and age  City", "Al  3  Rome", "Bo  4  Oslo", "    5  Bern"]
    assert html_text.render("<div>" * 50_000 + "x") == "x" and html_text.render("<ul>" + "<li><div>" * 5000 + "x").endswith("x")


def test_html_comments():
    for page in ("a<!-->b", "a<!--->b", "a<!---->b", "a<!--x--!>b", "a<!-- x > y -->b", "a<!-- <!-> -->b", "a<!doctype html>b", "a<!-x>b", "a<?x>b"):
        assert html_text.render(page) == "ab"
    assert html_text.render("a<!--x") == html_text.render("a<!" + "--<!" * 100_000) == "a" and html_text.render("a<!x") == "a"


def test_language_replaces_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "der die das und", "de", 7.0), (2, "the and of it", "en", 8.0), (None, None, "en", 9.0)], "doc_id long, text string, lang string, score double")
    found = language.predict(docs, language.train(docs), ["doc_id", "score", "lang"])
    assert found.columns == ["doc_id", "lang", "lang_pred", "score", "rejected"] and found.where("score <= 1").count() == 3
