"""Test cases: issues by their source, caches of answers, checkpoints, and ids of sources that have changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text as T

SEVERITIES = ("blocking", "warning", "info")


def issues(source: str) -> Column:
    """An array of struct(code, severity) for cases with query, context, expected (a map, null or empty if there is none),
    domain_expert and generator. source: customer, sme or synthetic; hybrid cases are checked as customers' are."""
    lacks = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    unanswered = F.coalesce(F.size("expected"), F.lit(0)) <= 0
    asks = T.asks_for_pii(F.col("query"))
    refuses = F.coalesce(F.try_element_at("expected", F.lit("should_reject")) == "true", F.lit(False))
    checks = {
        "customer": [
            (T.pii_type(F.col("query")).isNotNull(), "PII_IN_CONTENT", "blocking"), (asks, "PII_REQUEST", "info"), (asks & ~refuses, "PII_REQUEST_NO_REJECT", "warning"),
            (unanswered, "MISSING_EXPECTED", "warning"), (lacks("context"), "NO_CONTEXT", "info"),
        ],
        "sme": [(unanswered, "MISSING_EXPECTED", "blocking"), (lacks("domain_expert"), "NO_EXPERT_ATTRIBUTION", "warning")],
        "synthetic": [(lacks("generator"), "NO_GENERATOR_INFO", "warning")],
    }
    found = [F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for cond, code, severity in checks["customer" if source == "hybrid" else source]]
    return F.array_compact(F.array(*found))


def validate(cases: DataFrame, source: str) -> DataFrame:
    """Add issues, tags (array<string>) and valid, which no blocking issue leaves true."""
    out = cases.withColumn("issues", issues(source))
    tags = F.when(F.exists("issues", lambda i: i["code"] == "PII_REQUEST"), F.array(F.lit("adversarial:pii_request"))).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"tags": tags, "valid": ~F.exists("issues", lambda i: i["severity"] == "blocking")})


def cache_key(query: Column, domain: Column, types: Column, limit: Column, ticker: Column) -> Column:
    """The key of a retrieval's cached result; what isn't given is ``all``."""
    given = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("all"))
    return F.concat_ws(":", F.lit("rag"), F.substring(F.sha2(query, 256), 1, 16), given(domain), given(F.array_join(F.array_sort(types), ",")), limit.cast("string"), given(ticker))


def cache_entries(answers: DataFrame) -> DataFrame:
    """The entries to store for routed questions: one a question, the most confident, then the last. answers: (query, domain,
    confidence, at, vector). Unknown domains and answers without confidence are never stored."""
    usable = answers.where("domain IS NOT NULL AND domain <> 'unknown' AND confidence > 0")
    best = usable.groupBy(F.md5("query").alias("query_hash")).agg(F.max_by(F.struct("query", "domain", "confidence", "vector"), F.struct("confidence", "at", "domain")).alias("e"))
    return best.select("query_hash", "e.*")


def expire_sessions(sessions: DataFrame, active: str, last_at: Column, now: Column, minutes: int) -> DataFrame:
    """Sessions without activity for more than ``minutes`` become inactive."""
    idle = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(last_at.cast("timestamp"))
    return sessions.withColumn(active, F.col(active) & (idle <= 60 * minutes))


def progress(log: DataFrame, batch: str, at: str, passed: Column) -> DataFrame:
    """A batch's counters as of each entry's batch end: completed, passed, failed and when they were last touched."""
    ok = F.coalesce(passed, F.lit(False))
    return log.groupBy(batch).agg(F.count("*").alias("completed"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.max(at).alias("updated_at"))


def resume_offsets(log: DataFrame, source: str, offset: str, done: Column) -> DataFrame:
    """Where each source's import goes on: the first offset that isn't done, or the one after the last."""
    first_open = F.min(F.when(~F.coalesce(done, F.lit(False)), F.col(offset)))
    return log.groupBy(source).agg(F.coalesce(first_open, F.max(offset) + 1).alias("resume_at"), F.count_if(done).alias("n_done"))


def refreshed_ids(cases: DataFrame, found: DataFrame, n: int = 5) -> DataFrame:
    """(case_id, old, new, changed): each case's ids and the ``n`` best ones that a search finds now. cases: (case_id, ids
    array); found: (case_id, id, rank). Sets are compared, not orders; a case for which nothing is found keeps its ids."""
    now = found.where(F.col("rank") <= n).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r"))
    joined = cases.join(now, "case_id", "left").withColumn("new", F.coalesce(F.transform("r", lambda s: s["id"]), F.col("ids")))
    changed = F.array_sort(F.array_distinct("ids")) != F.array_sort(F.array_distinct("new"))
    return joined.select("case_id", F.col("ids").alias("old"), "new", changed.alias("changed"))


def without_children(parents: DataFrame, children: DataFrame, key: str, parent: str) -> DataFrame:
    """Parents that no child refers to."""
    return parents.join(children.select(F.col(parent).alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
