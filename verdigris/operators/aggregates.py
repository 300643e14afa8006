"""Scorecard, entity and telemetry aggregates. Each combines before its shuffle and is planned by Catalyst alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, digits: int | None = 4) -> Column:
    """part / whole, null where whole is 0."""
    out = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return out if digits is None else F.round(out, digits)


def comparison_summary(cards: DataFrame, by: list[str]) -> DataFrame:
    """Totals, passes, mean score, pass rate, tokens, cost and mean latency of each group.

    cards: passed boolean, score double, tokens long, cost double, latency double; nulls in tokens and cost count as 0,
    in score and latency they are left out of the mean.
    """
    passed = F.count_if("passed")
    return cards.groupBy(*by).agg(
        F.count("*").alias("total"),
        passed.alias("passed_n"),
        (F.count("*") - passed).alias("failed_n"),
        F.round(F.avg("score"), 4).alias("avg_score"),
        ratio(passed, F.count("*")).alias("pass_rate"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 2).alias("total_cost"),
        F.round(F.avg("latency"), 4).alias("avg_latency"),
    )


def batch_summary(cards: DataFrame) -> DataFrame:
    """One row: total, passed, failed, mean score (0 without rows)."""
    return cards.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed_n"), F.count_if(~F.col("passed")).alias("failed_n"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("avg_score"))


#: Metric name -> what it is of a day's scorecards.
TREND_METRICS = {
    "pass_rate": lambda: F.avg(F.col("passed").cast("double")),
    "avg_score": lambda: F.avg("score"),
    "avg_latency": lambda: F.avg("latency"),
    "total_cost": lambda: F.sum("cost"),
}


def daily_trend(cards: DataFrame, metric: str, unit: str = "day") -> DataFrame:
    """A metric by day (or another unit); an unknown metric is the pass rate."""
    value = TREND_METRICS.get(metric, TREND_METRICS["pass_rate"])()
    return cards.groupBy(F.date_trunc(unit, "created_at").alias("period")).agg(F.round(value, 6).alias("value"), F.count("*").alias("n"))


def batch_metrics(cards: DataFrame) -> DataFrame:
    """Per batch: number, pass rate, mean score, mean of the positive latencies, and when it began."""
    return cards.groupBy("batch_id").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"),
        F.round(F.avg("score"), 6).alias("avg_score"),
        F.round(F.avg(F.when(F.col("latency") > 0, F.col("latency"))), 6).alias("avg_latency"),
        F.max("created_at").alias("ended_at"),
    )


def request_summary(requests: DataFrame, by: list[str]) -> DataFrame:
    """Counts by outcome, and mean, median and upper percentiles of latency with linear interpolation.

    The percentiles are exact; a group's latencies are counted by value before they meet.
    """
    return requests.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "error").alias("failed"),
        F.count_if(F.col("outcome") != "error").alias("succeeded"),
        F.round(F.avg("latency"), 6).alias("mean"),
        F.round(F.percentile("latency", 0.5), 6).alias("median"),
        F.round(F.percentile("latency", 0.95), 6).alias("p95"),
        F.round(F.percentile("latency", 0.99), 6).alias("p99"),
        F.round(ratio(F.count_if(F.col("cached")), F.count("*"), None), 6).alias("cache_rate"),
    )


def coverage(rows: DataFrame, by: str, has: dict[str, Column]) -> DataFrame:
    """Per group: number, and for each named condition how many rows meet it and their percentage to two places."""
    columns = [c for name, cond in has.items() for c in (F.count_if(cond).alias(name), F.round(100.0 * F.count_if(cond) / F.nullif(F.count("*"), F.lit(0)), 2).alias(f"{name}_pct"))]
    return rows.groupBy(by).agg(F.count("*").alias("total"), *columns)


def ambiguous(rows: DataFrame, key: Column, identity: str, shown: str) -> DataFrame:
    """Keys that stand for more than one identity: how many, and which values are shown for them, in order."""
    return (
        rows.select(key.alias("key"), F.col(identity).alias("__id"), F.col(shown).alias("__shown"))
        .distinct()
        .groupBy("key")
        .agg(F.countDistinct("__id").alias("n"), F.array_join(F.array_sort(F.collect_set("__shown")), "|").alias("shown"), F.min("__shown").alias("first"))
        .where("n > 1")
    )


def stage_statistics(cards: DataFrame, stages: str) -> DataFrame:
    """Per stage of a map<name, struct<passed, score>>: number, pass rate and mean score."""
    return cards.select(F.explode(stages).alias("stage", "result")).groupBy("stage").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("result.passed").cast("double")), 6).alias("pass_rate"), F.round(F.avg("result.score"), 6).alias("avg_score")
    )
