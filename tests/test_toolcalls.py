"""Tool calls by expressions against the comparison in plain Python, on random nested calls and odd texts."""

import json
import random

import brute_calls
from pyspark.sql import functions as F

from verdigris.operators import toolcalls

ATOMS = [None, True, False, 0, 1, -1, 5, 100000, 100001, 1.0, 0.0, -0.0, 5.0, 100000.0, 1e30, 1.00001, 0.00001, 2.5e-7, "", "1", "1.0", " 5 ", "5\n", "1_0", "1e5", "x", 'a"b', "a\\", "é", "true", "null", "{", "a: 1, 2", "s", "10 ", 12345678901234567890123, "12345678901234567890124", 10]


def value(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.6:
        return rng.choice(ATOMS)
    if kind < 0.8:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["k", "a:b", "s", 'q"', "", "é", "1"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def twin(rng, v):
    """The same value, spelt otherwise in some places."""
    if isinstance(v, dict):
        return {k: twin(rng, v[k]) for k in rng.sample(list(v), len(v))}
    if isinstance(v, list):
        return [twin(rng, x) for x in v]
    kind = rng.random()
    if isinstance(v, (int, float)) and not isinstance(v, bool) and kind < 0.4:
        return rng.choice([str(v), float(v), v * 1.00001, v * 1.001])
    return rng.choice(ATOMS) if kind > 0.93 else v


def call(rng):
    name = rng.choice(["get_data", "refinitiv.get_data", "f", "f", "", None, 0, 0.0, 7])
    out = {rng.choice(["tool_name", "name"]): name} if rng.random() < 0.12 else {"tool_name": rng.choice(["get_data", "refinitiv.get_data", "f"])}
    if rng.random() < 0.1:
        out["name"] = "g"
    if rng.random() < 0.95:
        out["arguments"] = {k: value(rng) for k in rng.sample(["x", "y", "z"], rng.randrange(3))} if rng.random() < 0.97 else rng.choice(ATOMS)
    return out


def case(rng):
    want = [call(rng) for _ in range(rng.randrange(4))]
    want += [twin(rng, c) for c in want[:1] if rng.random() < 0.3]
    got = [twin(rng, c) for c in rng.sample(want, len(want)) if rng.random() < 0.9] + [call(rng) for _ in range(rng.random() < 0.2)]
    shape = lambda calls: rng.choice([calls, {"tool_calls": calls}, calls[0] if len(calls) == 1 else calls])
    text = lambda v: json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
    return text(shape(want)), text(shape(got))


ODD = ["", " ", "null", "{broken", "[1]", "{} x", "[],[]", '[] "a"', "01", "1.", "-", "NaN", "true1", '"a', '["a", "b]', "{}", "[]", "[[]]", '{"tool_calls": 1}', '{"tool_calls": null}', '{"name": "f"}', '{"tool_name": "", "name": "f"}', '{"tool_name": "f", "arguments": null}', '["f"]', None]


def judged(text):
    """error and numbers by brute force."""
    (e1, want), (e2, got) = map(brute_calls.parse_calls, text)
    return (e1 or e2, 0.0, 0, 0, 0) if e1 or e2 else (None, *brute_calls.compare(want, got))


def test_random_calls(spark):
    rng = random.Random(5)
    pairs = [case(rng) for _ in range(1500)] + [(a, b) for a in ODD for b in ODD]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, want string, got string").withColumns({"score": F.lit("z"), "__want": F.lit("kept")})
    rows = toolcalls.judge(df, "want", "got").collect()
    assert len(rows) == len(pairs) and {r["__want"] for r in rows} == {"kept"}
    wrong = [(r["want"], r["got"], tuple(r[c] for c in ("error", "score", "missing", "extra", "differing")), judged((r["want"], r["got"]))) for r in rows]
    assert not [w for w in wrong if w[2] != w[3]][:3]
    assert len({r["verdict"] for r in rows}) == 6


def test_random_arguments(spark):
    rng = random.Random(6)
    values = [{k: value(rng) for k in rng.sample(["x", "y", "z", "w"], 3)} for _ in range(600)]
    pairs = [(json.dumps(v), json.dumps(twin(rng, v) | {k: value(rng) for k in rng.sample("xyuv", 1)})) for v in values]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, want string, got string")
    names = ["missing_keys", "extra_keys", "value_diffs"]
    for r in toolcalls.diff_arguments(df, "want", "got").collect():
        diff = brute_calls.argument_diff(json.loads(r["want"]), json.loads(r["got"]))
        assert [r[n] for n in names] == [diff.get(n, []) for n in names], (r["want"], r["got"])


def test_long_and_deep_calls(spark):
    long, deep = {"x": "ab\\\" " * 100_000, "y": list(range(20_000))}, {"x": 1}
    for _ in range(300):
        deep = {"x": [deep, "1"]}
    many = [{"name": "f", "arguments": {"x": i}} for i in range(200)]
    texts = [json.dumps([{"name": "f", "arguments": a}]) for a in (long, deep)] + [json.dumps(many)]
    df = spark.createDataFrame([(i, t, json.dumps(json.loads(t)[::-1])) for i, t in enumerate(texts)], "id int, want string, got string")
    assert {r["verdict"] for r in toolcalls.judge(df, "want", "got").collect()} == {"OK"}
    repeated = spark.createDataFrame([('{"name": "f", "name": "f"}', "[]")], "want string, got string")
    assert toolcalls.judge(repeated, "want", "got").first()["error"] == "INVALID_JSON"
    assert "Python" not in toolcalls.judge(df, "want", "got")._jdf.queryExecution().executedPlan().toString()
