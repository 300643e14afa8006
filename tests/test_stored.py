"""Stored tables, files of pages, and what a session carries over."""

import os

from pyspark.sql import functions as F

from verdigris.operators import conversation
from verdigris.operators import upserts as U
from verdigris.sources import formats


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_merge_touches_few_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(i, f"v{i}", None if i % 2 else "x") for i in range(100)], "k long, v string, w string")
    U.store(old, path, "k", 8)
    before = files(path)
    new = spark.createDataFrame([(5, "new", None), (1000, "added", "y")], "k long, v string, w string")
    U.merge_into(spark, path, new, "k", 8, lambda o, n: U.upsert(o, n, "k", ["w"]))
    after = files(path)
    touched = {os.path.dirname(f) for f in before.keys() - after.keys()}
    assert 1 <= len(touched) <= 2 and all(after[f] == t for f, t in before.items() if os.path.dirname(f) not in touched)
    rows = {r["k"]: (r["v"], r["w"]) for r in U.stored(spark, path).collect()}
    assert len(rows) == 101 and rows[5] == ("new", None) and rows[1000] == ("added", "y") and rows[4] == ("v4", "x")
    U.merge_into(spark, path, new, "k", 8, lambda o, n: U.upsert(o, n, "k", ["w"]))  # again: the same table
    assert {r["k"]: (r["v"], r["w"]) for r in U.stored(spark, path).collect()} == rows
    U.merge_into(spark, path, new.limit(0), "k", 8, lambda o, n: U.upsert(o, n, "k"))
    assert U.stored(spark, path).count() == 101


def test_html_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>caf\xe9 \xc3\xa9</p>\n")
    (tmp_path / "b.html").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"no page")
    rows = {os.path.basename(r["path"]): r["html"] for r in formats.read_html(spark, str(tmp_path), "*.html").collect()}
    assert rows == {"a.html": "<p>caf� é</p>\n"}


def test_pages_in_files_of_many(spark, tmp_path):
    """Separators, escapes, line breaks and odd bytes in pages; few files for many pages."""
    odd = ["", "\n", "a\x1eb", "\x1b0\x1b1\x1b", "\x1e\x1e", "line\nline\r\n", "é\x00"]
    rows = [(i, h) for i, h in enumerate(odd)] + [(None, "no key"), (7, None), (8, "bytes")] + [(100 + i, "<p>x</p>") for i in range(500)]
    pages = spark.createDataFrame(rows, "k long, h string").coalesce(3).withColumn("h", F.when(F.col("k") == 8, F.concat("h", F.expr("cast(X'FFC3' as string)"))).otherwise(F.col("h")))
    path = str(tmp_path / "pages")
    formats.write_pages(pages, "k", "h", path)
    got = [tuple(r) for r in formats.read_pages(spark, path).collect()]
    want = [(None if k is None else str(k), "bytes\ufffd\ufffd" if k == 8 else h) for k, h in rows if h is not None]
    assert sorted(got, key=str) == sorted(want, key=str) and len(files(path)) <= 3


def test_session_context(spark):
    rows = [(1, 1, {"A": "a1", "B": "b1"}, "x", ["F(Period=FY1)", "G"]), (1, 2, None, None, None), (1, 3, {"A": "a3"}, "y", ["F(Period=FY2)", "F(Period=FY1)"])]
    rows += [(1, i, {}, None if i == 8 else "z", ["H"]) for i in range(4, 9)] + [(2, 1, None, None, None)]
    t = spark.createDataFrame(rows, "s int, t int, e map<string,string>, d string, f array<string>").repartition(3)
    got = {r["s"]: r for r in conversation.session_context(t, "s", "t", "e", "d", "f", recent=6).collect()}
    assert got[1]["entities"] == {"A": "a3", "B": "b1"} and got[1]["domain"] is None and got[1]["total_turns"] == got[1]["last_turn"] == 8
    assert got[1]["fields"] == ["F(Period=FY2)", "F(Period=FY1)"] + ["H"] * 5 and got[1]["periods"] == ["FY2", "FY1"]
    assert got[2]["entities"] == {} and got[2]["fields"] == got[2]["periods"] == []
    assert conversation.session_context(t.limit(0), "s", "t", "e", "d", "f").count() == 0


def test_keys_once_within_the_watermark(spark, tmp_path):
    """A repeated key is dropped while it is remembered, a late one falls behind the watermark, and old keys are forgotten."""
    from verdigris.streaming import jobs

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch = lambda rows: spark.createDataFrame(rows, "key string, at string").select("key", F.to_timestamp("at").alias("ts")).coalesce(1).write.mode("append").parquet(source)
    batch([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")])

    def run():
        stream = spark.readStream.schema("key string, ts timestamp").parquet(source)
        q = jobs.once_per_key(stream, "key", "1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]

    assert run() == 2
    batch([("a", "2024-01-01 00:30:00"), ("c", "2024-01-03 00:00:00")])
    assert run() == 1  # a and b are forgotten, c is remembered
    batch([("d", "2024-01-01 00:00:00"), ("c", "2024-01-03 00:10:00")])
    run()
    assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
