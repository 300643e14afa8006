"""Queries on dates, screening expressions, merges and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import fiscal, screen
from verdigris.operators import filters as P
from verdigris.operators import upserts as U
from verdigris.sources.shared import new_folder
from verdigris.sources.tables import spread, table

_EXPRESSIONS = ("-1D", "3M", "-2Y", "FY0", "FY-1", "FY2023", "FQ0", "FQ-3", "FQ22024", "2024-02-29", "2024-02-31", "-1W", " 12M ", "nonsense")


def date_rows(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("on"))
    pick = F.element_at(F.array(*[F.lit(x) for x in _EXPRESSIONS]), (F.col("o_orderkey") % len(_EXPRESSIONS) + 1).cast("int"))
    return o.withColumn("expr", pick)


_LIST = "[" + ", ".join(f"'{x}'" for x in _EXPRESSIONS) + "]"
DATES = f"""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ref, trim({_LIST}[o_orderkey % {len(_EXPRESSIONS)} + 1]) AS e FROM orders),
f AS (SELECT *, year(ref) + CAST(month(ref) > $M AS INT) AS fy, ((month(ref) - ($M % 12 + 1) + 12) % 12) // 3 + 1 AS fq,
             regexp_extract(e, '^(?:FY|FQ)?(-?[0-9]+)[DMY]?$', 1) AS num FROM d),
g AS (SELECT *, TRY_CAST(num AS INT) AS n FROM f),
q AS (SELECT *, CASE WHEN length(num) = 5 THEN CAST(substr(num, 2) AS INT) ELSE CAST(floor((fy * 4 + fq - 1 + n) / 4) AS INT) END AS qy,
             CASE WHEN length(num) = 5 THEN CAST(num[1] AS INT) ELSE ((fy * 4 + fq - 1 + n) % 4) + 1 END AS qq FROM g),
m AS (SELECT *, ($M % 12 + 1 + qq * 3 - 2) % 12 + 1 AS qm FROM q)
SELECT o_orderkey, CASE WHEN regexp_matches(e, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST(e AS DATE)
  WHEN regexp_matches(e, '^-?[0-9]+D$') THEN ref + n
  WHEN regexp_matches(e, '^-?[0-9]+M$') THEN CAST(ref + to_months(n) AS DATE)
  WHEN regexp_matches(e, '^-?[0-9]+Y$') THEN CAST(ref + to_months(12 * n) AS DATE)
  WHEN e LIKE 'FY%' THEN last_day(make_date(CASE WHEN length(num) = 4 THEN n ELSE fy + n END, $M, 1))
  WHEN e LIKE 'FQ%' THEN last_day(make_date(qy - CAST(qm > $M AND $M <> 12 AS INT), qm, 1)) END AS resolved
FROM m"""


def date_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return date_rows(spark, folder).select("o_orderkey", fiscal.resolve(F.col("expr"), F.col("on"), 12).alias("resolved"))


def fiscal_dates(spark: SparkSession, folder: str) -> DataFrame:
    return date_rows(spark, folder).select("o_orderkey", fiscal.resolve(F.col("expr"), F.col("on"), 6).alias("resolved"))


def fiscal_quarter(spark: SparkSession, folder: str) -> DataFrame:
    form = F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q")
    return table(spark, folder, "orders").select("o_orderkey", fiscal.filing_quarter(form, F.col("o_orderdate")).alias("quarter"))


def cron_match(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.where(fiscal.cron_matches(F.col("ts"), "*/15 8-18 * 1,2,3 0-4")).select("event_id", "ts")


def screen_build(spark: SparkSession, folder: str) -> DataFrame:
    """Questions put together from the parts table."""
    p = spread(table(spark, folder, "part").select("p_partkey", "p_size"), "p_partkey")
    country = F.element_at(F.array(F.lit("in the UK"), F.lit("from Japan"), F.lit("worldwide")), (F.col("p_partkey") % 3 + 1).cast("int"))
    question = F.concat_ws(" ", F.lit("Top"), F.col("p_size").cast("string"), F.when(F.col("p_size") > 25, "tech").otherwise("energy"), F.lit("firms"), country, F.lit("with PE below"), (F.col("p_partkey") % 40).cast("string"), F.when(F.col("p_size") % 2 == 0, "by revenue").otherwise("please"), F.when(F.col("p_partkey") % 4 == 0, "ROE below 30 and above 5, ROE over 5.5, dividend yield below 6, dividend yield more than 2"), F.when(F.col("p_partkey") % 5 == 0, "positive FCF that beat estimates by 10%"))
    return p.select("p_partkey", screen.build(question).alias("screen"))


def screen_top(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    columns = {"TR.PE": "p_size", "TR.Revenue": "p_retailprice", "TR.TRBCEconSectorCode": "p_type"}
    expression = f"SCREEN({screen.UNIVERSE},IN(TR.TRBCEconSectorCode,PROMO,ECONOMY),TR.PE<30,TR.PE>=4,TOP(TR.Revenue,15,nnumber),CURN=USD)"
    return screen.apply(p, expression, columns, "p_partkey").select("p_partkey", "p_retailprice")


def _new_customers(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.concat(F.lit("New "), "c_name").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("c_nationkey"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_custkey") % 5 == 0, "RETIRED").otherwise("ACTIVE").alias("c_mktsegment"))


_NEW = "WITH n AS (SELECT c_custkey * 2 AS c_custkey, 'New ' || c_name AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN 'RETIRED' ELSE 'ACTIVE' END AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0) "


def _merged(spark: SparkSession, folder: str, kept: list[str] | None = None) -> DataFrame:
    """Customers stored in parts, new ones merged into those, and the table read back."""
    path, old = new_folder(spark, "customers"), table(spark, folder, "customer")
    U.store(old, path, "c_custkey", 16)
    U.merge_into(spark, path, _new_customers(spark, folder), "c_custkey", 16, lambda o, n: U.upsert(o, n, "c_custkey", kept))
    return U.stored(spark, path).select(old.columns)


def sink_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder)


def sink_upsert_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder, ["c_nationkey", "c_acctbal"])


def sink_insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    return U.insert_ignore(table(spark, folder, "customer"), _new_customers(spark, folder), ["c_custkey"])


def sink_delta(spark: SparkSession, folder: str) -> DataFrame:
    d = U.delta(table(spark, folder, "customer"), _new_customers(spark, folder), "c_custkey", "c_mktsegment", "RETIRED")
    return d.groupBy("action").agg(F.count("*").alias("n"))


def sink_delete(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "customer").where("c_acctbal < 0 OR c_custkey % 7 = 0")
    return U.delete(table(spark, folder, "orders"), gone.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def cleanup_ttl(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the last 36 hours before the newest."""
    e = table(spark, folder, "events")
    newest = F.broadcast(e.agg(F.max("ts").alias("newest")))
    return e.join(newest, F.col("ts") >= F.col("newest") - F.expr("make_dt_interval(0, 36)")).select("event_id")


def lookback(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").where(F.to_date("o_orderdate") >= F.date_sub(F.lit("2001-06-30").cast("date"), 365 * 2)).select("o_orderkey")


def json_equals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").where(P.json_equals("props", "k", "12")).select("event_id")


def json_has(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy("event_type").agg(F.count_if(P.json_has("props", "k")).alias("has_k"), F.count_if(~P.json_has("props", "z")).alias("lacks_z"))


def json_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Add a quarter to the JSON of each event that lacks one, as maps."""
    e = table(spark, folder, "events")
    props = F.from_json("props", "map<string,string>")
    merged = F.when(F.map_contains_key(props, "quarter"), props).otherwise(F.map_concat(props, F.create_map(F.lit("quarter"), F.quarter("ts").cast("string"))))
    return e.select("event_id", merged["k"].alias("k"), merged["quarter"].alias("quarter"))


def parse_json(spark: SparkSession, folder: str) -> DataFrame:
    """JSON that may be broken: every seventh event's is cut short and counts as an empty object."""
    e = table(spark, folder, "events").withColumn("raw", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")))
    return e.select("event_id", F.variant_get(F.coalesce(F.try_parse_json("raw"), F.parse_json(F.lit("{}"))), "$.k", "int").alias("k"))


def likes(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.select("p_partkey", F.like("p_name", F.lit("small%")).alias("prefix"), F.ilike("p_brand", F.lit("%#1_")).alias("pattern"), (~F.like("p_type", F.lit("%MO%"))).alias("without"))


def lengths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(F.length("text").between(200, 900)).select("doc_id")


def cases(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    kind = F.when(F.col("p_type").startswith("PRO"), "promotion").when(F.col("p_size") <= 2, "tiny").otherwise("other")
    return p.select("p_partkey", kind.alias("kind"), F.substring("p_brand", 7, 10).alias("number"), F.coalesce(F.nullif(F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(""), F.lit("")), F.col("p_brand")).alias("label"))


def client_backfill(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").withColumn("client", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")))
    return o.groupBy(F.coalesce("client", F.lit("internal")).alias("client")).agg(F.count("*").alias("n"), F.count_if(F.col("client").isNull()).alias("filled"))


def fixture_id_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per case: how many of its three ids exist, and whether one does."""
    b = table(spark, folder, "benchmark").select("item_id", F.explode(F.array(F.col("item_id"), F.col("item_id") * 9, F.col("item_id") * 977)).alias("doc_id"))
    known = table(spark, folder, "documents").select("doc_id", F.lit(True).alias("there"))
    j = b.distinct().join(known, "doc_id", "left")
    return j.groupBy("item_id").agg(F.count("there").alias("found"), F.count_if(F.col("there").isNull()).alias("missing"), F.max(F.col("there").isNotNull()).alias("usable"))


def sample_capped(spark: SparkSession, folder: str) -> DataFrame:
    """60 parts in a seeded order, at most 6 of one brand."""
    from verdigris.operators import windows as W

    p = table(spark, folder, "part").select("p_partkey", "p_brand").withColumn("draw", W.seeded("p_partkey", 3))
    return W.top_n(p, ["p_brand"], [F.col("draw"), F.col("p_partkey")], 6).orderBy("draw", "p_partkey").limit(60).select("p_partkey", "p_brand")


def sample_random(spark: SparkSession, folder: str) -> DataFrame:
    from verdigris.operators import windows as W

    p = table(spark, folder, "part")
    return p.orderBy(F.when(F.length("p_name") <= 8, 0).otherwise(1), W.seeded("p_partkey", 5), "p_partkey").limit(30).select("p_partkey")


def request_metrics(spark: SparkSession, folder: str) -> DataFrame:
    from verdigris.operators import aggregates as A

    e = table(spark, folder, "events").select(F.col("event_type").alias("domain"), F.when(F.col("user_id") % 5 == 0, "error").otherwise("ok").alias("outcome"), F.col("value").alias("latency"), (F.col("event_id") % 3 == 0).alias("cached"))
    return A.request_summary(e, ["domain"])


def slow_requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").where("value > 150").orderBy(F.desc("value"), "event_id").limit(20).select("event_id", "value")


def dashboards(spark: SparkSession, folder: str) -> DataFrame:
    """Sliding windows of an hour by a quarter of one: errors over all, with at least one in the denominator."""
    e = table(spark, folder, "events")
    w = F.window(F.col("ts").cast("timestamp"), "1 hour", "15 minutes")
    errors = F.count_if(F.col("event_type") == "error")
    return e.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.round(errors / F.greatest(F.count("*"), F.lit(1)), 6).alias("error_rate")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "error_rate")


def ingest_daily(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day"), "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderkey").alias("last"))


def routing_stats(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("confidence"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def source_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and means per group, rolled up per source in a fixed order by the running mean (current + next) / 2."""
    p = table(spark, folder, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("mean"))
    rolled = p.groupBy("p_type").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("p_brand", "mean"))).alias("m"))
    running = F.aggregate(F.slice(F.col("m"), 2, F.size("m")), F.col("m")[0]["mean"], lambda a, x: (a + x["mean"]) / 2)
    return rolled.select("p_type", "total", F.round(running, 6).alias("running_mean"))


def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    words = F.split(F.lower("text"), " ")
    d = table(spark, folder, "benchmark").select("item_id", words.alias("a"), F.transform(F.reverse(words), lambda w: F.regexp_replace(w, r"e\z", "")).alias("b"))
    return d.select("item_id", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_except("a", "b")).alias("only_a"), F.size(F.array_union("a", "b")).alias("either"), F.array_join(F.array_distinct("a"), " ").alias("first"))


QUERIES = {
    "date_resolve": (date_resolve, DATES.replace("$M", "12")),
    "fiscal_dates": (fiscal_dates, DATES.replace("$M", "6")),
    "fiscal_quarter_derive": (fiscal_quarter, "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN quarter(o_orderdate) END AS quarter FROM orders"),
    "cron_match": (cron_match, "SELECT event_id, ts FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 18 AND month(ts) IN (1, 2, 3) AND isodow(ts) BETWEEN 1 AND 5"),
    "screen_build": (
        screen_build,
        "SELECT p_partkey, 'SCREEN(U(IN(Equity(active,public,primary))),' || CASE p_partkey % 3 WHEN 0 THEN 'TR.HQCountryCode=GB,' WHEN 1 THEN 'TR.HQCountryCode=JP,' ELSE '' END || 'IN(TR.TRBCEconSectorCode,' || CASE WHEN p_size > 25 THEN '57' ELSE '50' END || '),TR.PE<' || (p_partkey % 40) || CASE WHEN p_partkey % 4 = 0 THEN ',TR.DividendYield>2,TR.DividendYield<6,TR.ROE>5.5,TR.ROE<30' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ',TR.FreeCashFlow>0,TR.EPSSurprisePct(Period=FQ0)>10' ELSE '' END || ',TOP(' || CASE WHEN p_size % 2 = 0 THEN 'TR.Revenue' WHEN p_partkey % 4 = 0 THEN 'TR.DividendYield' ELSE 'TR.CompanyMarketCap' END || ',' || p_size || ',nnumber),CURN=USD)' AS screen FROM part",
    ),
    "screen_dsl": (screen_top, "SELECT p_partkey, p_retailprice FROM part WHERE p_type IN ('PROMO', 'ECONOMY') AND p_size < 30 AND p_size >= 4 ORDER BY p_retailprice DESC, p_partkey LIMIT 15"),
    "sink_upsert": (sink_upsert, _NEW + "SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, " + ", ".join(f"CASE WHEN n.c_custkey IS NULL THEN c.{x} ELSE n.{x} END AS {x}" for x in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")) + " FROM customer c FULL JOIN n ON n.c_custkey = c.c_custkey"),
    "sink_upsert_coalesce": (sink_upsert_coalesce, _NEW + "SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, coalesce(n.c_name, c.c_name) AS c_name, coalesce(n.c_nationkey, c.c_nationkey) AS c_nationkey, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(n.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN n ON n.c_custkey = c.c_custkey"),
    "sink_insert_ignore": (sink_insert_ignore, _NEW + "SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)"),
    "sink_delta_scd": (sink_delta, _NEW + "SELECT CASE WHEN n.c_mktsegment = 'RETIRED' THEN CASE WHEN c.c_custkey IS NULL THEN 'skip' ELSE 'retire' END WHEN c.c_custkey IS NOT NULL THEN 'update' ELSE 'insert' END AS action, count(*) AS n FROM n LEFT JOIN customer c ON c.c_custkey = n.c_custkey GROUP BY 1"),
    "sink_delete": (sink_delete, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_custkey % 7 = 0) GROUP BY 1"),
    "cleanup_ttl": (cleanup_ttl, "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 36 HOUR"),
    "filter_lookback": (lookback, "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2001-06-30' - 730"),
    "filter_json_eq": (json_equals, "SELECT event_id FROM events WHERE props->>'k' = '12'"),
    "filter_json_has": (json_has, "SELECT event_type, count(*) FILTER (json_exists(props, '$.k')) AS has_k, count(*) FILTER (NOT json_exists(props, '$.z')) AS lacks_z FROM events GROUP BY 1"),
    "project_json_merge": (json_merge, "SELECT event_id, props->>'k' AS k, CAST(quarter(ts) AS VARCHAR) AS quarter FROM events"),
    "project_parse_json": (parse_json, "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(props->>'k' AS INT) END AS k FROM events"),
    "filter_like": (likes, "SELECT p_partkey, p_name LIKE 'small%' AS prefix, p_brand ILIKE '%#1_' AS pattern, p_type NOT LIKE '%MO%' AS without FROM part"),
    "filter_between": (lengths, "SELECT doc_id FROM documents WHERE length(text) BETWEEN 200 AND 900"),
    "project_case": (cases, "SELECT p_partkey, CASE WHEN p_type LIKE 'PRO%' THEN 'promotion' WHEN p_size <= 2 THEN 'tiny' ELSE 'other' END AS kind, substr(p_brand, 7, 10) AS number, CASE WHEN p_size > 10 THEN p_name ELSE p_brand END AS label FROM part"),
    "client_backfill": (client_backfill, "SELECT coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END, 'internal') AS client, count(*) AS n, count(*) FILTER (o_orderkey % 4 = 0) AS filled FROM orders GROUP BY 1"),
    "fixture_id_check": (fixture_id_check, "WITH b AS (SELECT DISTINCT item_id, unnest([item_id, item_id * 9, item_id * 977]) AS doc_id FROM benchmark) SELECT item_id, count(d.doc_id) AS found, count(*) FILTER (d.doc_id IS NULL) AS missing, bool_or(d.doc_id IS NOT NULL) AS usable FROM b LEFT JOIN documents d USING (doc_id) GROUP BY 1"),
    "sample_capped": (sample_capped, "SELECT p_partkey, p_brand FROM (SELECT *, md5('3:' || p_partkey) AS draw FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('3:' || p_partkey), p_partkey) <= 6) ORDER BY draw, p_partkey LIMIT 60"),
    "sample_random": (sample_random, "SELECT p_partkey FROM part ORDER BY CASE WHEN length(p_name) <= 8 THEN 0 ELSE 1 END, md5('5:' || p_partkey), p_partkey LIMIT 30"),
    "agg_request_metrics": (
        request_metrics,
        "SELECT event_type AS domain, count(*) AS total, count(*) FILTER (user_id % 5 = 0) AS failed, count(*) FILTER (user_id % 5 <> 0) AS succeeded, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(count(*) FILTER (event_id % 3 = 0) / count(*), 6) AS cache_rate FROM events GROUP BY 1",
    ),
    "agg_slow_requests": (slow_requests, "SELECT event_id, value FROM events WHERE value > 150 ORDER BY value DESC, event_id LIMIT 20"),
    "agg_dashboards": (
        dashboards,
        "WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) AS start, event_type FROM events, range(4) r(i)) SELECT start, count(*) AS n, round(count(*) FILTER (event_type = 'error') / greatest(count(*), 1), 6) AS error_rate FROM w GROUP BY 1",
    ),
    "view_ingest_daily": (ingest_daily, "SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last FROM orders GROUP BY 1, 2"),
    "view_routing_stats": (routing_stats, "SELECT event_type, count(*) AS n, round(avg(value), 6) AS confidence, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1"),
    "agg_source_stats": (
        source_stats,
        "WITH g AS (SELECT p_type, p_brand, count(*) AS n, avg(p_retailprice) AS mean FROM part GROUP BY 1, 2), l AS (SELECT p_type, sum(n) AS total, list(mean ORDER BY p_brand) AS m FROM g GROUP BY 1) SELECT p_type, CAST(total AS BIGINT) AS total, round(list_reduce(m, lambda a, x: (a + x) / 2), 6) AS running_mean FROM l",
    ),
    "set_operations": (
        set_operations,
        r"WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS a FROM benchmark), d AS (SELECT *, list_transform(list_reverse(a), lambda x: regexp_replace(x, 'e\z', '')) AS b FROM w) SELECT item_id, len(list_distinct(list_intersect(a, b))) AS both, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS only_a, len(list_distinct(a || b)) AS either, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' ') AS first FROM d",
    ),
}
