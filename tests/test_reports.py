import datetime

import pytest
from pyspark.sql import functions as F

from verdigris.functions import routing
from verdigris.operators import reports as R
from verdigris.operators import validation
from verdigris.sources import formats


def test_empty_tables_give_defined_results(spark):
    none = spark.createDataFrame([], "k string, at timestamp, done long")
    assert R.category_report(none, "k", F.lit(True)).collect() == []
    assert R.share_where(none, F.lit(True), "share").first()["share"] is None
    assert R.table_counts({"none": none}).collect()[0]["n"] == 0
    assert R.progress_rate(none, "k", F.col("at"), "done", F.lit(5)).collect() == []


def test_null_verdicts_fail(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), (None, False)], "k string, ok boolean")
    got = {r["category"]: (r["passed"], r["failed"], r["rate"]) for r in R.category_report(rows, "k", F.col("ok")).collect()}
    assert got == {"a": (1, 1, 0.5), None: (0, 1, 0.0)}


def test_progress_rates(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("b", at + datetime.timedelta(seconds=s), d) for s, d in ((0, 0), (10, 20), (20, 30))], "b string, at timestamp, done long")
    got = [(r["overall_rate"], r["interval_rate"], r["eta"]) for r in R.progress_rate(rows, "b", F.col("at"), "done", F.lit(60)).orderBy("done").collect()]
    assert got == [(None, None, None), (2.0, 2.0, 20.0), (1.5, 1.0, 20.0)]


def test_json_keys_are_added_once(spark):
    rows = spark.createDataFrame([('{"a":1}',), (None,), ('{"b":"x"}',)], "j string")
    filled = R.add_json_keys(rows, "j", {"b": F.lit("new")})
    assert sorted(r["b"] for r in filled.select(F.get_json_object("j", "$.b").alias("b")).collect()) == ["new", "new", "x"]
    found = rows.where(R.json_contains("j", {"a": 1})).collect()
    assert len(found) == 1


def test_prefix_leaves_marked_rows_alone(spark):
    rows = spark.createDataFrame([("Company: A", 1), ("text", 2), (None, 3)], "c string, v int")
    got = [tuple(r) for r in R.prefix_missing(rows, "c", "Company:", F.lit("Company: B\n"), ["v"]).collect()]
    assert got == [("Company: A", 1), ("Company: B\ntext", None), ("Company: B\n", None)]


def test_schedules_stop_at_capacity(spark):
    rows = spark.createDataFrame([(i, "*/5 * * * *") for i in range(6)], "id int, cron string")
    now = F.lit("2024-01-01 00:05:00").cast("timestamp")
    due = R.due_schedules(rows, rows.where("id < 2"), "id", F.lit(True), "cron", ["*/5 * * * *"], now, 4)
    assert [r["id"] for r in due.orderBy("id").collect()] == [2, 3]
    assert R.due_schedules(rows, rows, "id", F.lit(True), "cron", ["*/5 * * * *"], now, 4).collect() == []


def test_import_stops_at_too_many_errors(spark):
    columns = "lei string, cik string, figi string, ticker string, country_code string, primary_name string, data_source string"
    rows = spark.createDataFrame([(None, "1", None, None, "US", "Acme", "x"), ("bad", None, None, None, "XX", "n/a", "x"), (None,) * 7], columns)
    checked = validation.validate_entities(rows, ["US"])
    good, bad = validation.split_valid(checked, 2)
    assert (good.count(), bad.count()) == (1, 2)
    with pytest.raises(ValueError):
        validation.split_valid(checked, 1)


def test_markdown_headers_are_no_codes(spark):
    text = "| Natural language | `Code` | D |\n| a , b | `X` | d |\n"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(formats.field_codes(F.col("t")).alias("r")).collect()
    assert [(list(r["hints"]), r["code"]) for r in got[0]["r"]] == [(["a", "b"], "X")]
    assert got[1]["r"] is None and got[2]["r"] == []


def test_routes_of_empty_questions(spark):
    q = spark.createDataFrame([("",), (None,), ("top stocks with price above 3",)], "q string")
    got = q.select(routing.route({"price": routing.price_score(F.col("q")), "screening": routing.screen_score(F.col("q"))}).alias("r"), routing.time_range(F.col("q")).alias("t")).collect()
    assert got[0]["r"]["domain"] == "unknown" and got[2]["r"]["domain"] == "screening"
    assert got[0]["t"] is None and got[1]["t"] is None
