"""Follow-up questions: what earlier turns of a session named carries over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: References to the last entity, longest first; words for a period; known metrics.
PRONOUNS = ("the company's", "that company's", "the company", "that company", "this company", "the stock's", "the stock", "their", "they", "its", "it")
PERIODS = "quarterly|annual(?:ly)?|(?:next|this|last) (?:year|quarter)"
QUARTERLY = "quarterly|(?:next|this|last) quarter"
METRICS = ("eps", "earnings", "revenue", "sales", "ebitda", "ebit", "profit", "income", "dividend", "dps", "price target", "rating", "recommendation", "pe", "p/e", "peg", "free cash flow", "fcf", "book value", "roe", "roa")
METRIC = r"^(?:what about|and|also|show(?: me)?|get)\s+(.+?)\??$"
COMPARE = r"^(?:what about|how about|and|compare (?:to |with )?|also|same for|now (?:for )?)\s*(.+?)[?!.,;:]*$"


def with_context(turns: DataFrame, session: str, order: str, entity: str, metric: str) -> DataFrame:
    """Add the last entity and metric named before each turn."""
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumns({"last_entity": F.last(entity, ignorenulls=True).over(before), "last_metric": F.last(metric, ignorenulls=True).over(before)})


def expand(query: Column, entity: Column, metric: Column) -> Column:
    """struct(text, kind, confidence) of a question with its references filled in: a pronoun by the last entity, "what about
    X" by the last metric, a short question on a period by both, "show me" a known metric by the last entity. Others stay,
    with a null kind."""
    low = F.trim(F.lower(query))
    spelt = F.lit(None).cast("string")
    for pronoun in reversed(PRONOUNS):
        owner = F.concat(entity, F.lit("'s")) if pronoun.endswith("'s") or pronoun == "its" else entity
        first = F.regexp_replace(query, rf"(?is)\A(.*?)\b{pronoun}\b", F.concat(F.lit("$1"), owner))
        spelt = F.when(low.rlike(rf"\b{pronoun}\b"), first).otherwise(spelt)
    other = F.regexp_extract(low, COMPARE, 1)
    asked = F.trim(F.regexp_extract(low, METRIC, 1))
    period = low.rlike(rf"\b(?:{PERIODS})\b")
    is_name = (other != "") & ~other.isin(*METRICS) & ~other.rlike(rf"^(?:{PERIODS}|yearly|monthly)$")
    named = F.concat(F.upper(F.substring(other, 1, 1)), F.substr(other, F.lit(2)))
    kind_of_period = F.when(low.rlike(rf"\b(?:{QUARTERLY})\b"), "quarterly").otherwise("annual")
    made = lambda text, kind, confidence: F.struct(text.alias("text"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
    return (
        F.when(entity.isNotNull() & spelt.isNotNull(), made(spelt, "entity", 0.9))
        .when(metric.isNotNull() & is_name, made(F.concat(F.lit("What is "), named, F.lit("'s "), metric, F.lit("?")), "comparison", 0.85))
        .when(entity.isNotNull() & metric.isNotNull() & period & (F.size(F.split(low, r"\s+")) <= 4), made(F.concat(F.lit("What is "), entity, F.lit("'s "), kind_of_period, F.lit(" "), metric, F.lit("?")), "period", 0.85))
        .when(entity.isNotNull() & asked.isin(*METRICS), made(F.concat(F.lit("What is "), entity, F.lit("'s "), asked, F.lit("?")), "metric", 0.85))
        .otherwise(F.struct(query.alias("text"), F.lit(None).cast("string").alias("kind"), F.lit(1.0).alias("confidence")))
    )


def last_turns(turns: DataFrame, session: str, order: str, n: int) -> DataFrame:
    """The last n turns of each session."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return turns.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def session_summary(turns: DataFrame, session: str, order: str) -> DataFrame:
    return turns.groupBy(session).agg(F.count("*").alias("total_turns"), F.max(order).alias("last_turn"))


def session_context(turns: DataFrame, session: str, order: str, entities: str, domain: str, fields: str, recent: int = 5) -> DataFrame:
    """What a follow-up question of each session builds on: total_turns, last_turn, entities (a map of all turns' entities,
    later turns winning), domain (the last turn's, null if it has none), and of the last ``recent`` turns the fields (an array,
    in order, repeats included) and periods (those that fields name as Period=..., each once, in order of appearance).

    turns: ``entities`` a map of texts, ``fields`` an array of texts; nulls have none. Turns of a session have different
    ``order``. A session's entities are reduced by name before they meet, so that a long session costs no more memory than
    its distinct names."""
    whole = turns.groupBy(session).agg(F.count("*").alias("total_turns"), F.max(order).alias("last_turn"), F.max_by(F.struct(domain), order).getField(domain).alias("domain"))
    named = turns.select(session, order, F.explode(entities).alias("__name", "__value"))
    latest = named.groupBy(session, "__name").agg(F.max_by("__value", order).alias("__value"))
    maps = latest.groupBy(session).agg(F.map_from_entries(F.collect_list(F.struct("__name", "__value"))).alias("entities"))
    few = last_turns(turns.select(session, order, F.coalesce(fields, F.array().cast("array<string>")).alias("__fields")), session, order, recent)
    said = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "__fields"))), lambda t: t["__fields"]))  # of ``recent`` turns
    asked = few.groupBy(session).agg(said.alias("fields"))
    period = lambda f: F.regexp_extract(f, r"Period=([^)]*)", 1)
    periods = F.array_distinct(F.transform(F.filter("fields", lambda f: F.contains(f, F.lit("Period="))), period))
    none = F.create_map().cast("map<string,string>")
    return whole.join(maps, session, "left").join(asked, session, "left").select(session, "total_turns", "last_turn", F.coalesce("entities", none).alias("entities"), "domain", "fields", periods.alias("periods"))
