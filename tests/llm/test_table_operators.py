import random
import zlib

from pyspark.sql import functions as F

from verdigris.llm import decontaminate, mixing, sharding, url_filter, warc
from verdigris.llm.url_filter import Rule


def brute_rule(rules, host, path):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)


def test_url_filter(spark):
    rng = random.Random(1)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", ""]) for _ in range(rng.randrange(1, 4)))
    path = lambda: "".join(rng.choice(["/", "x", "y"]) for _ in range(rng.randrange(5)))
    rules = [Rule(h, "/" + p if (p := path()) else "", rng.choice(["allow", "block"])) for _ in range(40) if (h := host().strip("."))]
    rows = [(i, f"http://{host()}" + (("/" + path()) if rng.random() < 0.8 else "") + rng.choice(["", "?q=/x", "#f"])) for i in range(400)]
    rows += [(-1, None), (-2, ""), (-3, "a.b/x"), (-4, "x://y://z"), (-5, "HTTPS://A.B/X\n/y"), (-6, "://")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'z' AS verdict", "1 AS host")
    got = {r["page_id"]: r for r in url_filter.judge(df, rules).collect()}
    assert len(got) == len(rows) and got[-4]["host"] == "y:" and got[-1]["host"] == got[-3]["path"] == ""
    for r in got.values():
        want = brute_rule(rules, r["host"], r["path"])
        assert (r["rule"], r["verdict"]) == ((want.text, want.verdict) if want else (None, "allow"))
    joined = url_filter.judge(df, rules, broadcast_bytes=0)
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in joined.collect()} == {k: (r["rule"], r["verdict"]) for k, r in got.items()}
    assert {r["verdict"] for r in url_filter.judge(df, [], default="block").collect()} == {"block"}


def test_sharding(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["same text", "x" * rng.randrange(200), "é" * 9, None, ""])) for i in range(500)] + [(7, "same text"), (None, "q"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("z")).repartition(5)
    got = sharding.shard_documents(df, 7).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None and r["text_crc32"]) == sorted((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows if i is not None and t)
    total, parts = sum(r["size"] for r in got), {}
    for r in got:
        parts.setdefault(r["shard"], []).append(r)
    assert sorted(parts) == list(range(7))
    for p in parts.values():
        assert sorted(r["slot"] for r in p) == list(range(len(p)))
        assert abs(sum(r["size"] for r in p) - total / 7) <= 220
    again = sharding.shard_documents(df.repartition(3), 7).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert sharding.shard_documents(df.limit(0), 7).count() == 0
    assert {r["shard"] for r in sharding.shard_by_bytes(df.select("doc_id", F.lit(0).alias("size")), 3, "size", [F.col("doc_id")]).collect()} == {0}


def fill(sizes, weights, budget, cap):
    target, open_ = {s: 0.0 for s in sizes}, set(sizes)
    left = budget
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > cap * sizes[s]}
        if not over:
            target.update({s: level * weights[s] for s in open_})
            return target
        target.update({s: cap * sizes[s] for s in over})
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing(spark):
    rng = random.Random(3)
    names = ["b", "a", None, "Z", "é", "", "hot"]
    rows = [(i, rng.choice(names + ["hot"] * 6), " ".join(["w"] * rng.randrange(0, 40)) + rng.choice(["", " ###", " x"])) for i in range(900)] + [(5000, "a", None), (5001, "a", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    got = mixing.mix_documents(df, (5.0, 2.0, 1.0), 1.5, 2.0).collect()
    size = {i: len((t or "").split()) for i, _, t in rows}
    sizes = {}
    for i, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    target = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2.0)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["size"] == size[r["id"]] and r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= 25 for s in sizes)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_documents(df.repartition(3), (5.0, 2.0, 1.0), 1.5, 2.0).collect()))
    assert mixing.mix_documents(df.limit(0), (5.0, 2.0, 1.0), 1.5, 2.0).count() == 0


def test_mixing_prefers_quality(spark):
    rows = [(i, "s", 1, 1.0 if i % 2 else 0.05) for i in range(4000)]
    measured = spark.createDataFrame(rows, "id long, source string, size long, quality double")
    targets = spark.createDataFrame([("s", 4000, 1000.0)], "source string, source_size long, target double")
    got = mixing.mix(measured, targets).where("copies > 0").select((F.col("id") % 2).alias("odd")).groupBy("odd").count().collect()
    counts = {r["odd"]: r["count"] for r in got}
    assert sum(counts.values()) == 1000 and counts[1] > 0.9 * 1000


def test_decontamination(spark):
    item = "If Anna Meyer buys 12 apples for 3.50 euros and sells 5 of them to Ben at the market, how many apples does Anna keep until the end of the long week in July, and why would Anna give the rest of them away to her friends?"
    other = item.replace("Anna", "Clara").replace("Meyer", "Brook").replace("12", "40").replace("3.50", "9").replace("July", "May")
    mixed = other.replace("why would Clara give", "why would Peter give")
    again = "When Tom had 7 coins then Tom gave 7 coins to a man who gave 7 coins to a boy who gave Tom 7 coins back again"
    jumbled = "When Ann had 3 coins then Bea gave 4 coins to a man who gave 5 coins to a boy who gave Cleo 6 coins back again"
    plain = "the cat sat on the mat while a dog ran over the hill and nobody saw it come back home again"
    docs = [(1, "Well then. " + item + " Bye."), (2, "So. " + other + " Ok."), (3, plain.upper()), (4, "nothing of that kind is in this text at all, not even one window of it"), (5, None), (6, ""), (7, "only, short"), (8, "x " + mixed), (9, jumbled), (None, item), (1, "Well then. " + item + " Bye.")]
    items = [(10, item), (15, again), (11, plain), (12, "Only short!"), (13, None), (14, ""), (10, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("z"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for t in (decontaminate.Templates(), decontaminate.Templates(broadcast_windows=0)):
        got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(d, b, t).collect()}
        assert {(1, 10), (2, 10), (3, 11), (7, 12), (8, 10)} == set(got)  # 8: one slot of ten stands for another value; 9: most do
        assert not got[1, 10]["reparameterised"] and got[2, 10]["reparameterised"] and got[1, 10]["windows"] == got[1, 10]["item_windows"]
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_decontamination_runs_short_items_and_changed_values(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))
    copied = "so 12 apples and then the baker took his basket to the shop where 12 people stood in a line and they all sang"
    docs = [(1, "before " + " ".join(long.split()[200:400]) + " after"), (2, "a b c " + " ".join(long.split()[10:25])), (3, "they said that green tea helps here and now and again"), (4, copied.replace("12 people", "13 people"))]
    items = [(10, long), (11, "Green tea helps!"), (12, copied)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for t in (decontaminate.Templates(), decontaminate.Templates(broadcast_windows=0)):
        got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(d, b, t).collect()}
        assert {(1, 10), (3, 11), (4, 12)} == set(got)
        assert got[1, 10]["windows"] == 193 and not got[4, 12]["reparameterised"]


def test_decontamination_of_questions_full_of_slots(spark):
    """Half of the tokens are slots; twins have other values everywhere, some of them equal by accident."""
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdgkmt" for b in "aeiou" for c in ("n", "r", "st", "lk")]
    names = [w.capitalize() for w in rng.sample(words, 40)]
    units = ["kg", "euros", "hours", "km", "days"]
    value = {"n": lambda: str(rng.choice([rng.randrange(2, 30), rng.randrange(100, 999)])), "p": lambda: rng.choice(names), "u": lambda: rng.choice(units)}

    def template(size):
        out = []
        while len(out) < size:
            out += rng.choice([["w"], ["w", "w"], ["n"], ["n", "u"], ["p"]])
        return [(k, rng.choice(words)) for k in out]

    def told(t):
        return " ".join(["so", *(w if k == "w" else value[k]() for k, w in t), "then"])

    templates = [template(rng.choice([12, 18, 30, 55])) for _ in range(60)]
    items = [(i, told(t)) for i, t in enumerate(templates)]
    twins = [(i, "before that all " + told(t) + " and after that") for i, t in enumerate(templates)]
    clean = [(1000 + i, " ".join(told(template(20)) for _ in range(4))) for i in range(80)]
    numbers = [(2000 + i, " ".join(value["n"]() for _ in range(300))) for i in range(5)]
    d, b = spark.createDataFrame(twins + clean + numbers, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()}
    assert sum((i, i) in found for i, _ in items) >= 0.95 * len(items)
    assert all(i == j for i, j in found)


def test_decontamination_of_numbers(spark):
    items = [(1, "12 + 30 = 42, and 5 * 6 = 30, so 42 - 30 = 12"), (2, "1 2 3 4 5 6 7 8 9 10 11 12"), (3, "Compute 12 plus 5 times 3 minus 4")]
    docs = [(1, "x 7 + 35 = 42, and 5 * 7 = 35, so 42 - 35 = 7 y"), (2, "before 1 2 3 4 5 6 7 8 9 10 11 12 after"), (3, "5 6 8 1 3 2 9 7 4 4 1 2 8"), (4, "Now: compute 9 plus 8 times 2 minus 1.")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()} == {(1, 1), (2, 2), (4, 3)}


def test_warc_round_trip(spark):
    long = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 20 + "</p>"
    pages = [(5, "http://b.org/x", long), (3, "http://www.a.org/y?q#f", long), (9, "http://b.org/x", long), (1, None, None), (2, "http://c.org\r\nX: y", ""), (4, "http://c.org/", "short"), (6, "http://c.org/", "short"), (None, "u://v", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record_type", F.lit("z")).repartition(3)
    rows = warc.archive(df).collect()
    import hashlib

    assert len(rows) == len(pages)
    for r in rows:
        url, html = next((u, h or "") for i, u, h in pages if i == r["page_id"])
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha256(html.encode()).hexdigest()
        again = html == long and r["page_id"] != 3
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if again else ("response", None))
    keys = [(r["url_key"], r["captured_at"]) for r in rows]
    assert keys == sorted(keys)
    assert warc.archive(df.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((f"k{rng.randrange(9)}", "t", rng.randrange(50), f"f{i}", j) for j in range(rng.randrange(12))) for i in range(k)]
        runs = [sorted(r, key=warc._order) for r in runs]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted((x for r in runs for x in r), key=warc._order)


def test_url_key():
    assert warc.url_key("https://www.Example.com:8080/A?b#c") == "com,example:8080)/A?b"
    assert warc.url_key(None) == ")/" and warc.url_key("http://a.b?x=/") == "b,a)?x=/"
