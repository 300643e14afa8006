"""Queries over scorecards, which the order lines stand for: a flag is a client, a month a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import aggregates as A
from verdigris.operators import filters as P
from verdigris.operators import regression as R
from verdigris.operators import windows as W
from verdigris.sources.tables import table


def cards(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM").alias("batch_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("card_id"),
        F.col("l_partkey").alias("case_id"),
        F.col("l_returnflag").alias("client"),
        F.col("l_linestatus").alias("version"),
        (F.col("l_discount") <= 0.06).alias("passed"),
        (1 - F.col("l_discount")).alias("score"),
        F.col("l_quantity").cast("long").alias("tokens"),
        F.col("l_extendedprice").alias("cost"),
        (F.col("l_tax") * 1000).alias("latency"),
        F.col("l_shipdate").alias("created_at"),
    )


CARDS = """
WITH cards AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS batch_id, l_orderkey * 10 + l_linenumber AS card_id, l_partkey AS case_id,
         l_returnflag AS client, l_linestatus AS version, l_discount <= 0.06 AS passed, 1 - l_discount AS score,
         CAST(l_quantity AS BIGINT) AS tokens, l_extendedprice AS cost, l_tax * 1000 AS latency, l_shipdate AS created_at
  FROM lineitem)
"""


def client_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return A.comparison_summary(cards(spark, folder), ["client", "version"])


def view_client_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Scores are decimals here, so that means which lie between two roundings fall the same way everywhere."""
    c = cards(spark, folder).withColumns({"day": F.date_trunc("day", "created_at"), "score": F.col("score").cast("decimal(12,4)")})
    summary = A.comparison_summary(c, ["client", "version", "day"])
    return summary.select("client", "version", "day", "total", "passed_n", F.col("avg_score").cast("double").alias("avg_score"))


def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    return A.batch_summary(cards(spark, folder).where(P.equals("batch_id", "1998-03")))


def client_trend(spark: SparkSession, folder: str) -> DataFrame:
    c = P.where_all(cards(spark, folder), [P.equals("client", "R"), *P.between("created_at", "1998-01-01", "1998-12-31")])
    return A.daily_trend(c, "pass_rate")


def batch_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return A.batch_metrics(cards(spark, folder))


def prev_batch(spark: SparkSession, folder: str) -> DataFrame:
    c = cards(spark, folder).where("created_at < '1998-06-01'")
    batches = c.groupBy("client", "batch_id").agg(F.max("created_at").alias("ended_at"))
    return W.latest(batches, ["client"], ["ended_at", "batch_id"])


def regression(spark: SparkSession, folder: str) -> DataFrame:
    c = cards(spark, folder)
    batches = c.groupBy("client", "batch_id").agg(
        F.count("*").alias("n"), F.max("created_at").alias("ended_at"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("score").alias("avg_score"), F.avg(F.when(F.col("latency") > 0, F.col("latency"))).alias("avg_latency")
    )
    out = R.against_previous(batches, "client")
    return out.withColumns({c: F.round(c, 6) for c in ("pass_rate", "prev_pass_rate")})


def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    c = cards(spark, folder).select("case_id", "card_id", "created_at", "score", "passed")
    return W.latest(c, ["case_id"], ["created_at", "card_id"])


def top3_per_group(spark: SparkSession, folder: str) -> DataFrame:
    c = cards(spark, folder).select("case_id", "card_id")
    return W.top_n(c, ["case_id"], [W.seeded("card_id", 7), F.col("card_id")], 3)


def distinct_on(spark: SparkSession, folder: str) -> DataFrame:
    c = cards(spark, folder).groupBy("client", "version", "batch_id").agg(F.min("card_id").alias("card_id"))
    return c


def page(spark: SparkSession, folder: str) -> DataFrame:
    return P.page(cards(spark, folder).select("card_id", "batch_id", "score"), [F.desc("batch_id"), F.asc("card_id")], 25, 50)


def filter_dynamic(spark: SparkSession, folder: str) -> DataFrame:
    c = cards(spark, folder)
    return P.where_all(c, [P.equals("client", "A"), P.equals("version", None), *P.between("tokens", 10, 40), ~F.col("passed")]).select("card_id", "tokens", "score")


def filter_date_range(spark: SparkSession, folder: str) -> DataFrame:
    return P.where_all(cards(spark, folder), P.between("created_at", "1998-02-01", "1998-02-07")).select("card_id", "created_at")


def scan_many(spark: SparkSession, folder: str) -> DataFrame:
    return P.by_ids(table(spark, folder, "orders"), "o_orderkey", ["1", "7", "x-1", "42", "999999999"]).select("o_orderkey", "o_totalprice")


def scan_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return P.by_ids(table(spark, folder, "customer"), "c_custkey", ["17"])


def matrix_compare(spark: SparkSession, folder: str) -> DataFrame:
    return cards(spark, folder).groupBy("batch_id").agg(
        F.count("*").alias("n"), F.round(100 * F.avg(F.col("passed").cast("double")), 4).alias("pass_pct"), F.round(F.avg("score"), 6).alias("avg_score"),
        F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 2).alias("cost"), F.round(F.avg("latency"), 6).alias("avg_latency"),
    )


def staged(spark: SparkSession, folder: str) -> DataFrame:
    """Scorecards with a map of stage results."""
    result = lambda passed, score: F.struct(passed.alias("passed"), score.alias("score"))
    return cards(spark, folder).withColumn(
        "stages",
        F.create_map(
            F.lit("retrieval"), result(F.col("score") >= 0.95, F.col("score")), F.lit("citation"), result(F.col("tokens") >= 10, F.col("tokens") / 50.0), F.lit("policy"), result(F.col("passed"), F.col("passed").cast("double")),
        ),
    )


STAGES = CARDS.rstrip() + """,
stages AS (
  SELECT card_id, 'retrieval' AS stage, score >= 0.95 AS ok, score AS s FROM cards
  UNION ALL SELECT card_id, 'citation', tokens >= 10, tokens / 50.0 FROM cards
  UNION ALL SELECT card_id, 'policy', passed, CAST(passed AS INT) FROM cards)
"""


def summary_export(spark: SparkSession, folder: str) -> DataFrame:
    return A.stage_statistics(staged(spark, folder), "stages")


def csv_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """A row a scorecard, two columns a stage, as they go into a CSV export."""
    s = staged(spark, folder)
    names = ("citation", "policy", "retrieval")
    return s.select("card_id", *[c for n in names for c in (F.col("stages")[n]["passed"].alias(f"{n}_passed"), F.round(F.col("stages")[n]["score"], 4).alias(f"{n}_score"))])


def scorecard_overall(spark: SparkSession, folder: str) -> DataFrame:
    """All stages pass; the weighted mean with a default weight for stages that have none."""
    weights = F.create_map(F.lit("retrieval"), F.lit(0.5), F.lit("citation"), F.lit(0.3))
    s = staged(spark, folder)
    entries = F.map_entries("stages")
    weight = lambda e: F.coalesce(F.try_element_at(weights, e["key"]), F.lit(0.25))
    total = F.aggregate(entries, F.lit(0.0), lambda a, e: a + weight(e))
    mean = F.aggregate(entries, F.lit(0.0), lambda a, e: a + weight(e) * e["value"]["score"]) / total
    return s.select("card_id", F.forall(F.map_values("stages"), lambda v: v["passed"]).alias("overall_passed"), F.round(mean, 6).alias("overall_score"))


def gate_short_circuit(spark: SparkSession, folder: str) -> DataFrame:
    """Stages in order policy, citation, retrieval; after a failed gate (policy) the later ones are absent."""
    s = staged(spark, folder)
    failed = ~F.col("stages")["policy"]["passed"]
    return s.select("card_id", F.col("stages")["policy"]["score"].alias("policy"), F.when(~failed, F.round(F.col("stages")["citation"]["score"], 6)).alias("citation"), F.when(~failed, F.round(F.col("stages")["retrieval"]["score"], 6)).alias("retrieval"))


PRICES = [("N", 3.0, 15.0), ("R", 0.25, 1.25)]


def cost(spark: SparkSession, folder: str) -> DataFrame:
    """Cost from per-million rates: the exact client's, else the first whose name is contained, else the default."""
    c = cards(spark, folder).select("card_id", "client", F.when(F.col("tokens") > 3, F.col("tokens")).alias("tokens_in"), F.col("tokens").alias("tokens_out"))
    rate = lambda i: F.when(F.col("client") == PRICES[0][0], PRICES[0][i]).when(F.col("client") == PRICES[1][0], PRICES[1][i]).otherwise((3.0, 15.0)[i - 1])
    return c.select("card_id", F.round(F.col("tokens_in") / 1e6 * rate(1) + F.col("tokens_out") / 1e6 * rate(2), 9).alias("usd"))


def metric_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters per client: cost in whole micro-dollars of each test, and latency in histogram buckets."""
    bounds = (10, 25, 50, 75, 100)
    bucket = F.lit("more")
    for b in reversed(bounds):
        bucket = F.when(F.col("latency") <= b, str(b)).otherwise(bucket)
    return cards(spark, folder).groupBy("client", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if("passed").alias("passed_n"), F.sum(F.floor(F.col("cost") * 1000000).cast("long")).alias("micro"))


QUERIES = {
    "agg_client_comparison": (
        client_comparison,
        CARDS
        + """
SELECT client, version, count(*) AS total, count(*) FILTER (passed) AS passed_n, count(*) FILTER (NOT passed) AS failed_n,
       round(avg(score), 4) AS avg_score, round(count(*) FILTER (passed) / count(*), 4) AS pass_rate,
       CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens, round(sum(coalesce(cost, 0)), 2) AS total_cost,
       round(avg(latency), 4) AS avg_latency
FROM cards GROUP BY client, version""",
    ),
    "view_client_comparison": (
        view_client_comparison,
        CARDS + "SELECT client, version, date_trunc('day', created_at) AS day, count(*) AS total, count(*) FILTER (passed) AS passed_n, "
        "CAST((2 * sum(CAST(round(score * 10000) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 10000 AS avg_score FROM cards GROUP BY ALL",
    ),
    "agg_batch_summary": (
        batch_summary,
        CARDS + "SELECT count(*) AS total, count(*) FILTER (passed) AS passed_n, count(*) FILTER (NOT passed) AS failed_n, round(coalesce(avg(score), 0), 6) AS avg_score FROM cards WHERE batch_id = '1998-03'",
    ),
    "agg_client_trend": (
        client_trend,
        CARDS + "SELECT date_trunc('day', created_at) AS period, round(avg(CAST(passed AS INT)), 6) AS value, count(*) AS n FROM cards WHERE client = 'R' AND created_at BETWEEN '1998-01-01' AND '1998-12-31' GROUP BY 1",
    ),
    "agg_batch_metrics": (
        batch_metrics,
        CARDS + "SELECT batch_id, count(*) AS n, round(avg(CAST(passed AS INT)), 6) AS pass_rate, round(avg(score), 6) AS avg_score, round(avg(latency) FILTER (latency > 0), 6) AS avg_latency, max(created_at) AS ended_at FROM cards GROUP BY 1",
    ),
    "agg_prev_batch": (
        prev_batch,
        CARDS + "SELECT client, batch_id, ended_at FROM (SELECT client, batch_id, max(created_at) AS ended_at FROM cards WHERE created_at < '1998-06-01' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY client ORDER BY ended_at DESC, batch_id DESC) = 1",
    ),
    "regression_detect": (
        regression,
        CARDS
        + """,
b AS (SELECT client, batch_id, count(*) AS n, max(created_at) AS ended_at, avg(CAST(passed AS INT)) AS pr, avg(score) AS sc,
             avg(latency) FILTER (latency > 0) AS la FROM cards GROUP BY 1, 2),
l AS (SELECT *, lag(batch_id) OVER w AS pb, lag(n) OVER w AS pn, lag(pr) OVER w AS ppr, lag(sc) OVER w AS psc, lag(la) OVER w AS pla
      FROM b WINDOW w AS (PARTITION BY client ORDER BY ended_at, batch_id)),
z AS (SELECT *, (ppr * pn + pr * n) / (pn + n) AS pool FROM l WHERE pb IS NOT NULL),
y AS (SELECT *, abs((ppr - pr) / nullif(sqrt(pool * (1 - pool) * (1.0 / pn + 1.0 / n)), 0)) / sqrt(2) AS x FROM z),
t AS (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM y)
SELECT client, batch_id, pb AS prev_batch_id, round(pr, 6) AS pass_rate, round(ppr, 6) AS prev_pass_rate, round(pr - ppr, 6) AS delta,
  CASE WHEN pr - ppr <= -0.05 THEN 'critical' WHEN pr - ppr <= -0.02 THEN 'warning' END AS pass_severity,
  CASE WHEN sc - psc <= -0.05 THEN 'critical' WHEN sc - psc <= -0.02 THEN 'warning' END AS score_severity,
  CASE WHEN la / pla >= 1.5 THEN 'critical' WHEN la / pla >= 1.3 THEN 'warning' END AS latency_severity,
  CASE WHEN pr - ppr <= -0.02 AND n >= 20 AND pn >= 20 AND pool > 0 AND pool < 1 THEN round(2 * (1 - 0.5 * (1 + (1 -
    (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x)))), 6) END AS p_value
FROM t""".replace("\n,", ","),
    ),
    "win_latest_per_key": (
        latest_per_key,
        CARDS + "SELECT case_id, card_id, created_at, score, passed FROM cards QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, card_id DESC) = 1",
    ),
    "win_top3_per_group": (
        top3_per_group,
        CARDS + "SELECT case_id, card_id FROM cards QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY md5('7:' || card_id), card_id) <= 3",
    ),
    "win_distinct_on": (
        distinct_on,
        CARDS + "SELECT DISTINCT ON (client, version, batch_id) client, version, batch_id, card_id FROM cards ORDER BY client, version, batch_id, card_id",
    ),
    "page": (page, CARDS + "SELECT card_id, batch_id, score FROM cards ORDER BY batch_id DESC, card_id LIMIT 25 OFFSET 50"),
    "filter_dynamic": (filter_dynamic, CARDS + "SELECT card_id, tokens, score FROM cards WHERE client = 'A' AND tokens BETWEEN 10 AND 40 AND NOT passed"),
    "filter_date_range": (filter_date_range, CARDS + "SELECT card_id, created_at FROM cards WHERE created_at BETWEEN '1998-02-01' AND '1998-02-07'"),
    "scan_many": (scan_many, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 42, 999999999)"),
    "scan_by_id": (scan_by_id, "SELECT * FROM customer WHERE c_custkey = 17"),
    "agg_matrix_compare": (
        matrix_compare,
        CARDS + "SELECT batch_id, count(*) AS n, round(100 * avg(CAST(passed AS INT)), 4) AS pass_pct, round(avg(score), 6) AS avg_score, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 2) AS cost, round(avg(latency), 6) AS avg_latency FROM cards GROUP BY 1",
    ),
    "agg_summary_export": (
        summary_export,
        STAGES + "SELECT stage, count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS pass_rate, round(avg(s), 6) AS avg_score FROM stages GROUP BY 1",
    ),
    "sink_csv_pivot": (
        csv_pivot,
        CARDS + "SELECT card_id, tokens >= 10 AS citation_passed, round(tokens / 50.0, 4) AS citation_score, passed AS policy_passed, CAST(passed AS DOUBLE) AS policy_score, score >= 0.95 AS retrieval_passed, round(score, 4) AS retrieval_score FROM cards",
    ),
    "scorecard_overall": (
        scorecard_overall,
        CARDS + "SELECT card_id, score >= 0.95 AND tokens >= 10 AND passed AS overall_passed, round((0.5 * score + 0.3 * tokens / 50.0 + 0.25 * CAST(passed AS INT)) / 1.05, 6) AS overall_score FROM cards",
    ),
    "gate_short_circuit": (
        gate_short_circuit,
        CARDS + "SELECT card_id, CAST(passed AS DOUBLE) AS policy, CASE WHEN passed THEN round(tokens / 50.0, 6) END AS citation, CASE WHEN passed THEN round(score, 6) END AS retrieval FROM cards",
    ),
    "cost": (
        cost,
        CARDS + "SELECT card_id, round(CASE WHEN tokens > 3 THEN tokens END / 1e6 * CASE client WHEN 'R' THEN 0.25 ELSE 3.0 END + tokens / 1e6 * CASE client WHEN 'R' THEN 1.25 ELSE 15.0 END, 9) AS usd FROM cards",
    ),
    "metric_counters": (
        metric_counters,
        CARDS
        + """
SELECT client, CASE WHEN latency <= 10 THEN '10' WHEN latency <= 25 THEN '25' WHEN latency <= 50 THEN '50' WHEN latency <= 75 THEN '75'
            WHEN latency <= 100 THEN '100' ELSE 'more' END AS bucket,
       count(*) AS n, count(*) FILTER (passed) AS passed_n, CAST(sum(CAST(floor(cost * 1000000) AS BIGINT)) AS BIGINT) AS micro
FROM cards GROUP BY ALL""",
    ),
}
