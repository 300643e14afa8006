"""Reports on batches and tables, and maintenance of rows that an import left incomplete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import fiscal
from verdigris.operators.aggregates import ratio


def category_report(cards: DataFrame, category: str, passed: Column) -> DataFrame:
    """passed, failed, total and rate of each category; a null verdict counts as failed."""
    ok = F.coalesce(passed, F.lit(False))
    return cards.groupBy(F.col(category).alias("category")).agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.count("*").alias("total"), ratio(F.count_if(ok), F.count("*")).alias("rate"))


def share_where(rows: DataFrame, condition: Column, name: str, scale: float = 1.0) -> DataFrame:
    """One row: the share of rows for which the condition holds, null without rows."""
    return rows.agg((F.lit(scale) * F.count_if(condition) / F.nullif(F.count("*"), F.lit(0))).alias(name))


def batch_status(tasks: DataFrame, batch: str, completed: Column, failed: Column) -> DataFrame:
    """completed, failed, total and progress in per cent of each batch."""
    counted = tasks.groupBy(batch).agg(F.count_if(completed).alias("completed"), F.count_if(failed).alias("failed"), F.count("*").alias("total"))
    return counted.withColumn("progress", (F.col("completed") + F.col("failed")) / F.col("total") * 100)


def progress_rate(log: DataFrame, batch: str, at: Column, done: str, total: Column) -> DataFrame:
    """Add overall_rate and interval_rate, both a second, and eta, in seconds at the overall rate. ``done`` rises with the
    time; a batch's first entry has no rates."""
    order = Window.partitionBy(batch).orderBy(done)
    seconds = F.unix_seconds(at.cast("timestamp"))
    timed = log.withColumn("__s", seconds)
    since = F.col("__s") - F.first("__s").over(order)
    step = F.col("__s") - F.lag("__s").over(order)
    rates = timed.withColumns(
        {"overall_rate": F.try_divide(F.col(done) - F.first(done).over(order), since), "interval_rate": F.try_divide(F.col(done) - F.lag(done).over(order), step), "__left": total - F.col(done)}
    )
    return rates.withColumn("eta", F.try_divide("__left", "overall_rate")).drop("__s", "__left")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def counts_in_one_row(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with a count for each table, by its name."""
    return table_counts(tables).agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])


def latest_batches(rows: DataFrame, batch: str, at: str, n: int) -> DataFrame:
    """The ``n`` batches with the latest entries, and how many entries they have."""
    return rows.groupBy(batch).agg(F.max(at).alias("latest"), F.count("*").alias("n")).orderBy(F.desc("latest"), batch).limit(n)


def resume(cases: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Cases without a score; null keys are never scored."""
    return cases.join(scored.select(key).distinct(), key, "left_anti")


def retry_dead(dead: DataFrame, key: str, attempt: str, n: int = 1000) -> DataFrame:
    """The first ``n`` dead letters by key as new tasks: their attempts begin at 1."""
    return dead.orderBy(key).limit(n).withColumns({attempt: F.lit(1), "state": F.lit("pending")})


def checkpoints(log: DataFrame, job: str, at: str, tie: str, status: str, resumable: list[str], keep_since: Column) -> DataFrame:
    """The last status of each job with a resumable flag; finished jobs from before ``keep_since`` are dropped."""
    last = log.groupBy(job).agg(F.max_by(F.struct(F.col(status).alias("status"), F.col(at).alias("last_at")), F.struct(at, tie)).alias("l")).select(job, "l.*")
    return last.withColumn("resumable", F.col("status").isin(*resumable)).where(F.col("resumable") | (F.col("last_at") >= keep_since))


def due_schedules(schedules: DataFrame, running: DataFrame, key: str, enabled: Column, expression: str, expressions: list[str], now: Column, capacity: int) -> DataFrame:
    """Schedules that start now: enabled, not running, with a cron expression that the minute fits; by key, as many as the
    capacity leaves. ``expressions`` are the ones in use; a schedule with another never starts."""
    fits = reduce(lambda a, b: a | b, [(F.col(expression) == e) & fiscal.cron_matches(now, e) for e in expressions])
    busy = running.select(key).distinct()
    free = max(0, capacity - busy.limit(capacity).count())
    return schedules.where(enabled & fits).join(busy, key, "left_anti").orderBy(key).limit(free)


def unacknowledged(alerts: DataFrame, since: Column, at: str, acknowledged: Column, tie: str, n: int) -> DataFrame:
    """The latest ``n`` alerts from ``since`` on that nobody has acknowledged."""
    return alerts.where((F.col(at) >= since) & ~F.coalesce(acknowledged, F.lit(False))).orderBy(F.desc(at), tie).limit(n)


def missing_fields(cases: DataFrame, pack: str, required: dict[str, list[str]]) -> Column:
    """Array of the required fields that are null or blank, by the case's pack; a pack without rules requires nothing."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    out = F.array().cast("array<string>")
    for name, fields in required.items():
        out = F.when(F.col(pack) == name, F.array_compact(F.array(*[F.when(blank(f), f) for f in fields]))).otherwise(out)
    return out


def prefix_missing(rows: DataFrame, content: str, marker: str, header: Column, derived: list[str]) -> DataFrame:
    """Rows whose content doesn't begin with ``marker`` get the header before it; what was derived from the old content
    becomes null."""
    lacks = ~F.coalesce(F.col(content), F.lit("")).startswith(marker)
    return rows.withColumns({content: F.when(lacks, F.concat(header, F.coalesce(F.col(content), F.lit("")))).otherwise(F.col(content))} | {c: F.when(~lacks, F.col(c)) for c in derived})


def add_json_keys(rows: DataFrame, json: str, values: dict[str, Column]) -> DataFrame:
    """Add keys to a flat JSON object of strings or numbers where they are missing; keys that are there
    stay, and all values become strings."""
    have = F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))
    add = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()]))
    return rows.withColumn(json, F.to_json(F.map_concat(F.map_filter(add, lambda k, _: ~F.map_contains_key(have, k)), have)))


def json_contains(json: str, values: dict[str, object]) -> Column:
    """Whether a flat JSON object holds all of these values."""
    have = F.from_json(json, "map<string,string>")
    return F.coalesce(reduce(lambda a, b: a & b, [have[k] == str(v) for k, v in values.items()]), F.lit(False))


def cross_product(entities: DataFrame, templates: list[str], fields: list[str], name: str) -> DataFrame:
    """Add a question for each template and field, with {name} and {field} filled in."""
    each = entities.withColumn("template", F.explode(F.array(*[F.lit(t) for t in templates]))).withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields])))
    return each.withColumn("question", F.replace(F.replace("template", F.lit("{name}"), F.col(name)), F.lit("{field}"), F.col("field"))).drop("template")


def search_names(entities: DataFrame, query: str, name: str, filters: list[Column], n: int) -> DataFrame:
    """Entities whose name holds all words of the query; shorter names first, then by name."""
    own = F.split(F.lower(name), r"\s+")
    found = reduce(lambda a, b: a & b, [F.array_contains(own, w) for w in query.lower().split()] + filters)
    return entities.where(found).withColumn("rank", 1 / F.size(own)).orderBy(F.desc("rank"), name).limit(n)
