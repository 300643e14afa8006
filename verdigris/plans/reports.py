"""Queries on reports, maintenance and round trips through files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions import fiscal
from verdigris.operators import filters as P
from verdigris.operators import reports as R
from verdigris.operators import toolcalls, validation
from verdigris.operators import upserts as U
from verdigris.operators import windows
from verdigris.sources import formats
from verdigris.sources.shared import new_folder
from verdigris.sources.tables import spread, table

_COUNTED = ("documents", "pages", "benchmark")
_ALL = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_TEMPLATES, _FIELDS = ["What is the {field} of {name}?", "{name} {field} last year"], ["price", "volume", "yield"]
_CRONS = ["*/15 8-18 * * *", "0 0 1 * *"]
_NOW = "2024-03-04 09:30:00"


def category_report(spark: SparkSession, folder: str) -> DataFrame:
    return R.category_report(table(spark, folder, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F")


def low_confidence_rate(spark: SparkSession, folder: str) -> DataFrame:
    return R.share_where(table(spark, folder, "lineitem"), F.col("l_discount") < 0.05, "low_rate")


def embedding_pct(spark: SparkSession, folder: str) -> DataFrame:
    return R.share_where(table(spark, folder, "embeddings"), F.col("embedding").isNotNull() & (F.col("label") > 0), "pct", 100.0)


def batch_status(spark: SparkSession, folder: str) -> DataFrame:
    return R.batch_status(table(spark, folder, "orders"), "o_custkey", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P")


def batch_list(spark: SparkSession, folder: str) -> DataFrame:
    return R.latest_batches(table(spark, folder, "orders"), "o_custkey", "o_orderdate", 20)


def progress_rate(spark: SparkSession, folder: str) -> DataFrame:
    ranked = table(spark, folder, "events").select("user_id", "event_id", "ts", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("done"))
    return R.progress_rate(ranked, "user_id", F.col("ts"), "done", F.lit(1000)).select("event_id", "overall_rate", "interval_rate", "eta")


def verify_restore(spark: SparkSession, folder: str) -> DataFrame:
    return R.table_counts({name: table(spark, folder, name) for name in _ALL})


def scalar_subqueries(spark: SparkSession, folder: str) -> DataFrame:
    return R.counts_in_one_row({name: table(spark, folder, name) for name in _COUNTED})


def batch_resume(spark: SparkSession, folder: str) -> DataFrame:
    scored = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.resume(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), scored, "o_orderkey")


def dlq_retry(spark: SparkSession, folder: str) -> DataFrame:
    dead = table(spark, folder, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.lit(4).alias("attempt"))
    return R.retry_dead(dead, "o_orderkey", "attempt")


def index_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "signup", "paused").otherwise("running")
    since = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return R.checkpoints(e.withColumn("status", status), "user_id", "ts", "event_id", "status", ["failed", "paused", "running"], since)


def scheduler_tick(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").withColumn("cron", F.when(F.col("p_size") % 3 == 0, _CRONS[0]).when(F.col("p_size") % 3 == 1, _CRONS[1]).otherwise("bad"))
    running = table(spark, folder, "part").where("p_partkey BETWEEN 1 AND 10").select("p_partkey")
    return R.due_schedules(p, running, "p_partkey", F.col("p_size") > 5, "cron", _CRONS, F.lit(_NOW).cast("timestamp"), 40).select("p_partkey", "cron")


def alert_unacked(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").where("event_type = 'error'")
    return R.unacknowledged(e, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), "ts", F.col("user_id") % 2 == 0, "event_id", 50).select("event_id", "ts", "user_id")


def testcase_validate(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))).withColumn("note", F.when(F.col("c_custkey") % 3 == 0, " ").otherwise("x"))
    missing = R.missing_fields(c, "c_mktsegment", {"BUILDING": ["c_name"], "MACHINERY": ["c_name", "note"]})
    return c.select("c_custkey", F.array_join(missing, ",").alias("missing"))


def prefix_backfill(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return R.prefix_missing(p, "p_name", "small", F.concat(F.lit("Company: "), F.col("p_brand"), F.lit(" | ")), ["p_size"])


def fiscal_backfill(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "ts", "props")
    filled = R.add_json_keys(e, "props", {"fiscal_quarter": F.quarter("ts"), "k": F.lit(-1)})
    read = F.from_json("props", "map<string,string>")
    return filled.select("event_id", read["fiscal_quarter"].cast("int").alias("fiscal_quarter"), read["k"].cast("int").alias("k"))


def json_contains(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").where(R.json_contains("props", {"k": 3})).select("event_id")


def distinct_tickers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.get_json_object("props", "$.k").alias("k")).where("k IS NOT NULL").distinct()


def fixture_cross_product(spark: SparkSession, folder: str) -> DataFrame:
    return R.cross_product(table(spark, folder, "customer").select("c_custkey", "c_name"), _TEMPLATES, _FIELDS, "c_name").select("c_custkey", "field", "question")


def text_search_entity(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string")).alias("name"))
    return R.search_names(p, "ring", "name", [F.col("p_brand") != "Brand#11"], 25).select("p_partkey", "name")


def sink_staged_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines staged by part: the first of each part sets its size."""
    staged = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("p_size"))
    first = windows.top_n(staged, ["p_partkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("p_size")], 1).select("p_partkey", "p_size")
    path = new_folder(spark, "parts")
    U.store(table(spark, folder, "part").select("p_partkey", "p_size"), path, "p_partkey", 16)
    U.merge_into(spark, path, first, "p_partkey", 16, lambda old, new: U.upsert(old, new, "p_partkey"))
    return U.stored(spark, path).select("p_partkey", "p_size")


def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "json")
    formats.write_json(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path)
    return formats.read_jsonl(spark, path, "o_orderkey long, o_orderpriority string, o_totalprice double")


def csv_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as gzipped CSV of legal entities, read back: a fifth inactive, some without a name."""
    c = table(spark, folder, "customer")
    k = F.col("c_custkey")
    rows = c.select(
        F.lpad(k.cast("string"), 20, "a").alias("LEI"), F.when(k % 7 == 0, " ").otherwise(F.concat(F.col("c_name"), F.lit(', "Ltd"'))).alias("Entity.LegalName"), F.lit("us").alias("Entity.LegalAddress.Country"),
        F.lit("US-NY").alias("Entity.LegalAddress.Region"), F.lit("New York").alias("Entity.LegalAddress.City"), F.lit("GENERAL").alias("Entity.EntityCategory"), F.when(k % 5 == 0, "INACTIVE").otherwise("Active").alias("Entity.EntityStatus"),
    )
    path = new_folder(spark, "csv")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", "gzip").csv(path)
    return formats.read_entities_csv(spark, path).select("lei", "primary_name", "country_code", "entity_category", "entity_status")


def fixture_json(spark: SparkSession, folder: str) -> DataFrame:
    """A fixture file of cases for each region, read back as test cases."""
    n = table(spark, folder, "nation")
    expected = F.struct(F.array(F.col("n_nationkey").cast("string")).alias("relevant_docs"), F.lit("answer").alias("behavior"))
    case = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.struct(F.col("n_name").alias("query")).alias("input"), expected.alias("expected"))
    path = new_folder(spark, "fixtures")
    files = n.groupBy("n_regionkey").agg(F.collect_list(case).alias("test_cases")).select(F.to_json(F.struct("test_cases")).alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(path)
    return formats.fixture_cases(spark, path).select("id", "query", F.array_join("relevant", ",").alias("relevant"), "behaviour", "requires_citations")


def tags_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as cases with two tags, of which one is asked for."""
    o = table(spark, folder, "orders").withColumn("tags", F.array("o_orderpriority", "o_orderstatus"))
    return P.where_all(o, [P.overlaps("tags", ["1-URGENT", "P"])]).select("o_orderkey")


def sink_copy(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and suppliers appended to one table in turn, read back."""
    path = new_folder(spark, "copy")
    formats.append_parquet(table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), path)
    formats.append_parquet(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), path)
    return spark.read.schema("k long, name string").parquet(path)


def args_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Arguments of which some are missing, added, or of another value."""
    line, n = spread(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_orderkey"), F.col("l_linenumber")
    want = F.to_json(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty")))
    got = F.to_json(F.struct(F.when(n % 3 != 0, F.col("l_partkey").cast("string")).alias("part"), (F.col("l_quantity") + F.when(n % 2 == 0, 1).otherwise(0)).alias("qty"), F.when(n == 5, 1).alias("extra")))
    d = toolcalls.diff_arguments(line.select("l_orderkey", "l_linenumber", want.alias("want"), got.alias("got")), "want", "got")
    return d.select("l_orderkey", "l_linenumber", *[F.array_join(c, ",").alias(c) for c in ("missing_keys", "extra_keys", "value_diffs")])


def date_equivalent(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of date expressions, seen from the day of an order: are they the same day, and is the second one an expression?"""
    o = table(spark, folder, "orders").withColumn("on", F.to_date("o_orderdate"))
    other = F.element_at(F.array(F.date_format(F.date_sub("on", 1), "yyyy-MM-dd"), F.lit("-1D"), F.lit("-2D"), F.lit("someday"), F.lit("2023-02-31")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", fiscal.equivalent(F.lit("-1D"), other, F.col("on")).alias("same"), fiscal.is_expression(other).alias("valid"))


def error_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The valid rows of an import that allows for many bad ones."""
    rows = table(spark, folder, "customer").select("c_custkey", "c_acctbal", (F.col("c_acctbal") >= 0).alias("valid"))
    return validation.split_valid(rows, 1_000_000)[0].select("c_custkey", "c_acctbal")


def failed_requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "ts", "user_id")


_QUESTIONS = " UNION ALL ".join(f"SELECT c_custkey, '{f}' AS field, replace('{t}', '{{name}}', c_name) AS q FROM customer" for t in _TEMPLATES for f in _FIELDS)

QUERIES = {
    "category_report": (category_report, "SELECT o_orderpriority AS category, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, count(*) FILTER (WHERE o_orderstatus <> 'F') AS failed, count(*) AS total, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4) AS rate FROM orders GROUP BY 1"),
    "low_confidence_rate": (low_confidence_rate, "SELECT count(*) FILTER (WHERE l_discount < 0.05) / count(*) AS low_rate FROM lineitem"),
    "embedding_pct": (embedding_pct, "SELECT 100.0 * count(*) FILTER (WHERE embedding IS NOT NULL AND label > 0) / count(*) AS pct FROM embeddings"),
    "batch_status": (batch_status, "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, count(*) AS total, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) / count(*) * 100 AS progress FROM orders GROUP BY 1"),
    "batch_list": (batch_list, "SELECT o_custkey, max(o_orderdate) AS latest, count(*) AS n FROM orders GROUP BY 1 ORDER BY latest DESC, o_custkey LIMIT 20"),
    "progress_rate": (
        progress_rate,
        """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
r AS (SELECT event_id, done, (done - 1) / nullif(s - first_value(s) OVER w, 0) AS overall_rate, (done - lag(done) OVER w) / nullif(s - lag(s) OVER w, 0) AS interval_rate FROM l WINDOW w AS (PARTITION BY user_id ORDER BY done))
SELECT event_id, overall_rate, interval_rate, (1000 - done) / nullif(overall_rate, 0) AS eta FROM r""",
    ),
    "verify_restore": (verify_restore, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _ALL)),
    "scalar_subqueries": (scalar_subqueries, "SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) AS {t}" for t in _COUNTED)),
    "batch_resume": (batch_resume, "SELECT o_orderkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')"),
    "dlq_retry": (dlq_retry, "SELECT o_orderkey, 1 AS attempt, 'pending' AS state FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1000"),
    "index_checkpoint": (
        index_checkpoint,
        """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
s AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'paused' ELSE 'running' END AS status, ts AS last_at FROM l WHERE n = 1)
SELECT *, status <> 'complete' AS resumable FROM s WHERE status <> 'complete' OR last_at >= TIMESTAMP '2024-01-15'""",
    ),
    "scheduler_tick": (scheduler_tick, f"SELECT p_partkey, '{_CRONS[0]}' AS cron FROM part WHERE p_size > 5 AND p_size % 3 = 0 AND p_partkey NOT BETWEEN 1 AND 10 ORDER BY p_partkey LIMIT 30"),
    "alert_unacked": (alert_unacked, "SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND user_id % 2 <> 0 ORDER BY ts DESC, event_id LIMIT 50"),
    "testcase_validate": (testcase_validate, "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN CASE WHEN c_custkey % 5 = 0 THEN 'c_name' ELSE '' END WHEN 'MACHINERY' THEN concat_ws(',', CASE WHEN c_custkey % 5 = 0 THEN 'c_name' END, CASE WHEN c_custkey % 3 = 0 THEN 'note' END) ELSE '' END AS missing FROM customer"),
    "prefix_backfill": (prefix_backfill, "SELECT p_partkey, CASE WHEN p_name LIKE 'small%' THEN p_name ELSE 'Company: ' || p_brand || ' | ' || p_name END AS p_name, p_brand, CASE WHEN p_name LIKE 'small%' THEN p_size END AS p_size FROM part"),
    "fiscal_backfill": (fiscal_backfill, "SELECT event_id, quarter(ts) AS fiscal_quarter, coalesce(CAST(json_extract_string(props, '$.k') AS INT), -1) AS k FROM events"),
    "json_contains": (json_contains, "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '3'"),
    "distinct_tickers": (distinct_tickers, "SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL"),
    "fixture_cross_product": (fixture_cross_product, f"SELECT c_custkey, field, replace(q, '{{field}}', field) AS question FROM ({_QUESTIONS})"),
    "text_search_entity": (text_search_entity, "SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_partkey AS name FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'ring') AND p_brand <> 'Brand#11' ORDER BY len(string_split(p_name, ' ')), name LIMIT 25"),
    "sink_staged_upsert": (sink_staged_upsert, "SELECT coalesce(p.p_partkey, s.l_partkey) AS p_partkey, coalesce(s.size, p.p_size) AS p_size FROM part p FULL JOIN (SELECT l_partkey, CAST(first(l_quantity ORDER BY l_orderkey, l_linenumber, l_quantity) AS INT) AS size FROM lineitem GROUP BY 1) s ON p.p_partkey = s.l_partkey"),
    "filter_tags_overlap": (tags_overlap, "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'"),
    "sink_copy": (sink_copy, "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier"),
    "args_diff": (args_diff, "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'part' ELSE '' END AS missing_keys, CASE WHEN l_linenumber = 5 THEN 'extra' ELSE '' END AS extra_keys, CASE WHEN l_linenumber % 2 = 0 THEN 'qty' ELSE '' END AS value_diffs FROM lineitem"),
    "date_equivalent": (date_equivalent, "SELECT o_orderkey, o_orderkey % 5 <= 1 AS same, o_orderkey % 5 <> 3 AS valid FROM orders"),
    "ingest_error_budget": (error_budget, "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0"),
    "agg_failed_requests": (failed_requests, "SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20"),
    "sink_json": (json_round_trip, "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders"),
    "src_csv_stream": (csv_entities, "SELECT upper(lpad(CAST(c_custkey AS VARCHAR), 20, 'a')) AS lei, c_name || ', \"Ltd\"' AS primary_name, 'US' AS country_code, 'general' AS entity_category, 'active' AS entity_status FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0"),
    "src_fixture_json": (fixture_json, "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS query, CAST(n_nationkey AS VARCHAR) AS relevant, 'answer' AS behaviour, true AS requires_citations FROM nation"),
}
