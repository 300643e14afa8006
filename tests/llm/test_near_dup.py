import random

from verdigris.llm.components import connected_components
from verdigris.llm.near_dup import Forest, near_duplicates


def shingles(text, width):
    words = (text or "").encode().split()
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < width else frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        words = rng.choices(vocabulary, k=rng.choice([3, 8, 60, 150]))
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.choice([0, 0, 1, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, " \n\t"), (len(rows) + 3, "ÄÖ ä"), (len(rows) + 4, "äö ä")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (4, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, forest=Forest(width=width)).collect()}
        assert got == brute(rows, width)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (3, "a b c d e f", "z"), (4, None, None)], "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (3, 2, 1, False), (4, 0, 4, True), (None, 2, None, False)], key=repr)
    assert near_duplicates(df.limit(0)).count() == 0


def test_long_text_and_large_group(spark):
    base = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i % 7] + [f"x{i}"] + base[i % 7 + 1 :])) for i in range(60)] + [(100, "y " * 300_000), (101, "y " * 300_000 + "z")]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(60)} == {0} and got[100] == 100 and got[101] == 101


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(90)] + [(5, 5), (None, 3)]
    parent = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    real = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in real}


def test_dense_region(spark):
    """Pages of one template, about 0.7 alike, of which some pairs are 0.8 or more: far more than the reach in every run."""
    rng = random.Random(8)
    template = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(240):
        own = [f"p{i}x{k}" for k in range(17)]
        rows.append((len(rows), " ".join(template + own)))
        if i % 12 == 0:
            rows.append((len(rows), " ".join(template + own[:10] + [f"q{i}x{k}" for k in range(7)])))
    group = [f"g{k}" for k in range(100)]
    rows += [(len(rows) + k, " ".join(group[:k] + ["other"] + group[k + 1 :])) for k in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for reach in (1, 8):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, forest=Forest(reach=reach)).collect()}
        assert got == brute(rows, 5)


def test_across_partitions(spark):
    """With few orders, alike documents on both sides of a boundary are found as well."""
    rows = []
    for i in range(60):
        words = [f"d{i}w{k}" for k in range(400)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, forest=Forest(trees=2, least_depth=1, key_depth=2)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 2 for i, _ in rows}
