"""Queries that score answers. An assistant's turn answers the user's turn before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import ir
from verdigris.functions import similarity as S
from verdigris.functions import stages as G
from verdigris.operators.retrieval import shared_runs
from verdigris.sources.tables import table

#: Policies of one's own, of each kind.
RULES = (G.Rule("names_source", "medium", pattern=r"\bsource \d"), G.Rule("terse", "low", must_contain="the"), G.Rule("no_mail", "unknown", must_not_contain="mail"))

_EXTRA = (
    " [Source 1] and [2], see [Source 9].",
    " I cannot provide that. I'm sorry, unfortunately.",
    " Mail jo.doe@example.org or call 555-123-4567.",
    " Unfortunately that is all.",
    " We will hack the server. 123-45-6789",
)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, turn, query, said, response, context, chunks; responses get citations, refusals and personal data in turn, and
    the context spells some words otherwise."""
    c = table(spark, folder, "conversations")
    mine = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("said"))
    asked = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
    extra = F.element_at(F.array(*[F.lit(x) for x in _EXTRA]), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    response = F.when(F.col("turn") % 9 == 1, extra).otherwise(F.concat("said", extra))
    out = mine.join(asked, ["conv_id", "turn"]).withColumn("response", response)
    near = F.replace(F.col("said"), F.lit("ou"), F.lit("o"))
    return out.select("conv_id", "turn", "query", "said", "response", F.concat_ws(" ", "query", near).alias("context"), F.array(F.col("query"), F.col("said"), near).alias("chunks"))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ANSWERS = f"""
WITH pairs AS (
  SELECT a.conv_id, a.turn, u.text AS query, a.text AS said, {_sql_list(_EXTRA)}[(a.conv_id + a.turn) % 5 + 1] AS extra
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'),
answers AS (
  SELECT conv_id, turn, query, said, CASE WHEN turn % 9 = 1 THEN extra ELSE said || extra END AS response, query || ' ' || replace(said, 'ou', 'o') AS context,
         [query, said, replace(said, 'ou', 'o')] AS chunks FROM pairs)
"""


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(trim(regexp_replace(lower({x}), '\s+', ' ', 'g')), ' '), lambda w: w <> '')"


def _grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, len({x}) - 1), lambda i: array_to_string({x}[i:i + 2], ' ')))"


def faithfulness(spark: SparkSession, folder: str) -> DataFrame:
    a = answers(spark, folder).withColumn("score", F.round(G.faithfulness(F.col("response"), F.col("context")), 6))
    return a.select("conv_id", "turn", "score", (F.col("score") >= 0.4).alias("passed"))


def context_relevance(spark: SparkSession, folder: str) -> DataFrame:
    a = answers(spark, folder).withColumn("score", F.round(G.context_relevance(F.col("query"), F.col("chunks")), 6))
    return a.select("conv_id", "turn", "score", (F.col("score") >= 0.35).alias("passed"))


def answer_relevance(spark: SparkSession, folder: str) -> DataFrame:
    return answers(spark, folder).select("conv_id", "turn", F.round(_relevance(), 6).alias("score"), (F.round(_relevance(), 6) >= G.DEFAULT["answer_relevance"]).alias("passed"))


def _relevance() -> Column:
    """Some questions have keywords, and some should be refused."""
    keywords = F.when(F.col("turn") % 4 == 1, F.slice(S.tokens(F.col("query")), 1, 3)).otherwise(F.array().cast("array<string>"))
    return G.answer_relevance(F.col("query"), F.col("response"), keywords, F.when(F.col("conv_id") % 3 == 0, "reject").otherwise("answer"))


def _retrieval() -> Column:
    """The retrieval stage's score, for answers that take consecutive sources."""
    found, wanted = F.sequence(F.col("turn"), F.col("turn") + 4), F.array(F.col("conv_id") % 7, F.col("turn") + 1 + F.col("conv_id") % 3)
    wanted = F.array_distinct(wanted)
    return 0.3 * ir.recall_at_k(wanted, found, 5) + 0.2 * ir.precision_at_k(wanted, found, 5) + 0.3 * ir.mrr(wanted, found) + 0.2 * ir.hit_rate(wanted, found)


def citation(spark: SparkSession, folder: str) -> DataFrame:
    a = answers(spark, folder)
    return a.select("conv_id", "turn", F.array_join(F.array_sort(G.citations(F.col("response"))), ",").alias("cited"), F.round(G.citation_score(F.col("response"), F.lit(5)), 6).alias("score"), (F.round(G.citation_score(F.col("response"), F.lit(5)), 6) >= G.DEFAULT["citation"]).alias("passed"))


def policy(spark: SparkSession, folder: str) -> DataFrame:
    a = answers(spark, folder).withColumn("found", G.violations(F.col("response"), RULES))
    return a.select("conv_id", "turn", F.array_join(F.array_sort(F.transform("found", lambda v: v["kind"])), ",").alias("kinds"), F.round(G.policy_score(F.col("found")), 6).alias("score"), (~G.grave(F.col("found"))).alias("passed"))


def rejection(spark: SparkSession, folder: str) -> DataFrame:
    return answers(spark, folder).select("conv_id", "turn", G.rejection_class(F.col("response")).alias("behaviour"))


def source_policy(spark: SparkSession, folder: str) -> DataFrame:
    """The question may not be used, what was said only be quoted; some responses quote it."""
    response = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('"'), F.split("said", "[.!?]")[0], F.lit('". '), "response")).otherwise(F.col("response"))
    a = answers(spark, folder).withColumn("r", response)
    of = lambda source, policy: G.source_policy_violation(F.col("r"), F.col(source), F.lit(policy))
    return a.select("conv_id", "turn", of("query", "no_use").alias("violated"), of("context", "quote_only").alias("reworded"))


def pii_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("lang", *[F.regexp_count("text", F.lit(p)).alias(k) for p, k in G.PII]).groupBy("lang").agg(*[F.sum(k).alias(k) for _, k in G.PII])


def ngram_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """How many distinct five-word runs each document shares with the benchmark."""
    return shared_runs(table(spark, folder, "documents"), table(spark, folder, "benchmark"), "doc_id", "item_id", 5)


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    """One row per distinct text: the first 16 hex digits of its hash, how many rows have it and the first of them."""
    docs = table(spark, folder, "documents").select("doc_id", F.substring(F.sha2(F.col("text"), 256), 1, 16).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def pack_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The weighted mean of the stages that aren't gates, the pack's verdict (no failed gate, and a plain mean of 0.3 or more),
    and the scorecard's, for which every stage must pass."""
    s = _stages(spark, folder)
    names = {"retrieval": 0.15, "context_relevance": 0.15, "faithfulness": 0.25, "answer_relevance": 0.15, "citation": 0.1}
    mean = sum((F.col(n) * w for n, w in names.items()), F.lit(0.0)) / sum(names.values())
    plain = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    each = F.lit(True)
    for n in names:
        each = each & (F.round(n, 6) >= G.DEFAULT[n])
    return s.select("conv_id", "turn", F.round(mean, 6).alias("score"), (F.col("gate") & (F.round(plain, 6) >= 0.3)).alias("passed"), (F.col("gate") & each).alias("overall_passed"))


def _stages(spark: SparkSession, folder: str) -> DataFrame:
    r, c, q = F.col("response"), F.col("context"), F.col("query")
    gate = ~G.grave(G.violations(r)) & ~G.source_policy_violation(r, q, F.lit("no_use"))
    return answers(spark, folder).select(
        "conv_id", "turn", _retrieval().alias("retrieval"), G.context_relevance(q, F.col("chunks")).alias("context_relevance"), G.faithfulness(r, c).alias("faithfulness"),
        _relevance().alias("answer_relevance"), G.citation_score(r, F.lit(5)).alias("citation"), gate.alias("gate"),
    )


def pack_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """The retrieval pack: two stages, of which the first decides."""
    s = _stages(spark, folder)
    return s.select("conv_id", "turn", F.round(0.6 * F.col("retrieval") + 0.4 * F.col("context_relevance"), 6).alias("score"), (F.round("retrieval", 6) >= G.DEFAULT["retrieval"]).alias("passed"))


def pack_faithfulness(spark: SparkSession, folder: str) -> DataFrame:
    """The faithfulness pack: its one stage's score and verdict."""
    return faithfulness(spark, folder)


def provider_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """How many answers pass each stage, by the provider whose thresholds hold."""
    provider = F.element_at(F.array(F.lit("openai"), F.lit("anthropic"), F.lit("other")), (F.col("conv_id") % 3 + 1).cast("int"))
    s = _stages(spark, folder).withColumn("provider", provider)
    return s.groupBy("provider").agg(*[F.count_if(F.round(n, 6) >= G.threshold(F.col("provider"), n)).alias(n) for n in G.DEFAULT])


def semantics_score(spark: SparkSession, folder: str) -> DataFrame:
    """Judged parts, which order lines stand for, in one score."""
    part = lambda c: F.col(c).cast("decimal(12,4)")
    score = F.round(G.semantics(1 - part("l_discount"), 1 - part("l_tax"), part("l_quantity") / 50).cast("decimal(12,8)"), 6)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", score.cast("double").alias("score"), (score >= 0.7).alias("passed"))


def _rx(p: str) -> str:
    return p.replace("'", "''")


_COUNT = " + ".join(f"CAST(regexp_matches(lower(response), '{_rx(p)}') AS INT)" for p in (*G.REJECTION, "|".join(G.CUTOFF), "|".join(G.INVENTED)))
_KINDS = ", ".join(f"CASE WHEN regexp_matches(response, '(?i){_rx(p)}') THEN '{k}' END" for p, k in (*G.PII, *G.PROHIBITED))
_WEIGHT = "list_sum(list_transform(kinds, lambda k: CASE WHEN k IN ('violence', 'security') THEN 1.0 ELSE 0.8 END))"
_REFUSES = "(" + " OR ".join(f"contains(lower(response), '{_rx(p)}')" for p in G.REJECTION if p not in G.APOLOGIES) + ")"
_CITED = "list_distinct(" + " || ".join(f"regexp_extract_all(response, '{_rx(p)}', 1)" for p in G.CITATIONS) + ")"
_SCORED = ANSWERS.rstrip() + f""",
t AS (SELECT *, {_words('query')} AS q, {_words('response')} AS r, {_words('context')} AS c, {_CITED} AS cited,
             list_filter([{_KINDS}], lambda k: k IS NOT NULL) AS kinds,
             len(list_filter(regexp_split_to_array(response, '[.!?]+'), lambda s: length(trim(s)) > 20)) AS sentences FROM answers),
g AS (SELECT *, {_grams('r')} AS gr, {_grams('c')} AS gc, list_distinct(q) AS qd, list_distinct(r) AS rd FROM t),
s AS (SELECT *, CASE WHEN len(r) < 3 THEN 1.0 ELSE len(list_intersect(gr, gc)) / len(gr) END AS faithful,
             (SELECT avg(least(1.0, 2 * coalesce(len(list_intersect(qd, list_distinct({_words('chunk')}))) / nullif(len(qd), 0), 0))) FROM (SELECT unnest(chunks) AS chunk)) AS relevant,
             CASE WHEN len(cited) = 0 THEN 0.0 ELSE 0.2 * 1 + 0.3 * len(list_filter(cited, lambda x: CAST(x AS BIGINT) BETWEEN 1 AND 5)) / len(cited) + 0.3 * 1 + 0.2 * least(1.0, len(cited) / greatest(1, sentences)) END AS citing,
             list_distinct([conv_id % 7, turn + 1 + conv_id % 3]) AS wanted, range(turn, turn + 5) AS found,
             CASE WHEN {_REFUSES} AND conv_id % 3 = 0 THEN 1.0 WHEN {_REFUSES} THEN 0.0 WHEN length(response) < 20 THEN 0.3
                  WHEN turn % 4 = 1 AND len(q) > 0 THEN 0.5 * len(list_filter(q[1:3], lambda k: contains(lower(response), lower(k)))) / len(q[1:3]) + 0.3 * coalesce(len(list_intersect(qd, rd)) / nullif(len(qd), 0), 0) + least(0.2, length(response) / 500.0)
                  ELSE least(1.0, 0.8 * coalesce(len(list_intersect(qd, rd)) / nullif(len(qd), 0), 0) + least(0.2, length(response) / 500.0)) END AS answering,
             CASE WHEN len(kinds) = 0 THEN 1.0 ELSE greatest(0.0, 1 - {_WEIGHT} / len(kinds)) END AS policy,
             coalesce(len(list_intersect(qd, rd)) / nullif(len(qd), 0), 0) AS overlap FROM g),
p AS (SELECT *, len(list_filter(found, lambda i: list_contains(wanted, i))) AS n_found,
             coalesce(1 / list_min(list_filter(list_transform(wanted, lambda w: list_position(found, w)), lambda i: i > 0)), 0) AS first FROM s),
w AS (SELECT *, 0.3 * n_found / len(wanted) + 0.2 * n_found / 5 + 0.3 * first + 0.2 * CAST(n_found > 0 AS INT) AS retrieving,
             NOT list_has_any(kinds, ['ssn', 'passport', 'credit_card', 'email', 'phone', 'violence', 'security']) AND overlap <= 0.3 AS gate FROM p)
"""
_BARE = "lower(regexp_replace({0}, '^[\"'']+|[\"'']+$', '', 'g'))"
_QUOTING = ANSWERS.rstrip() + f""",
b AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN '"' || regexp_split_to_array(said, '[.!?]')[1] || '". ' || response ELSE response END AS r FROM answers),
t AS (SELECT *, list_distinct({_words('query')}) AS qd, list_distinct({_words('r')}) AS rd, list_distinct({_words('context')}) AS theirs,
             list_transform(regexp_extract_all(r, '"([^"]+)"', 1) || regexp_extract_all(r, '''([^'']+)''', 1), lambda x: lower(x)) AS quoted,
             list_filter(list_transform(regexp_split_to_array(r, '[.!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) >= 20 AND NOT regexp_matches(s, '(?s)^".*"$|^''.*''$')) AS sentences FROM b),
u AS (SELECT conv_id, turn, unnest(sentences) AS s, quoted, theirs FROM t),
v AS (SELECT *, list_distinct({_words(_BARE.format('s'))}) AS mine FROM u WHERE NOT list_contains(quoted, {_BARE.format('s')})),
x AS (SELECT DISTINCT conv_id, turn FROM v WHERE len(mine) > 0 AND len(list_intersect(mine, theirs)) / len(mine) > 0.4 AND len(list_intersect(mine, theirs)) / len(mine) < 0.95)
SELECT conv_id, turn, coalesce(len(list_intersect(qd, rd)) / nullif(len(qd), 0), 0) > 0.3 AS violated, (conv_id, turn) IN (SELECT (conv_id, turn) FROM x) AS reworded FROM t"""
_MEAN = "(0.15 * retrieving + 0.15 * relevant + 0.25 * faithful + 0.15 * answering + 0.1 * citing) / 0.8"
_PLAIN = "(retrieving + relevant + faithful + answering + citing) / 5"
_PASSES = "round(retrieving, 6) >= 0.5 AND round(relevant, 6) >= {0} AND round(faithful, 6) >= 0.4 AND round(answering, 6) >= 0.5 AND round(citing, 6) >= 0.6"

QUERIES = {
    "stage_faithfulness": (faithfulness, _SCORED + "SELECT conv_id, turn, round(faithful, 6) AS score, round(faithful, 6) >= 0.4 AS passed FROM s"),
    "stage_context_relevance": (context_relevance, _SCORED + "SELECT conv_id, turn, round(relevant, 6) AS score, round(relevant, 6) >= 0.35 AS passed FROM s"),
    "stage_answer_relevance": (
        answer_relevance,
        _SCORED + "SELECT conv_id, turn, round(answering, 6) AS score, round(answering, 6) >= 0.5 AS passed FROM s",
    ),
    "stage_citation": (citation, _SCORED + "SELECT conv_id, turn, array_to_string(list_sort(cited), ',') AS cited, round(citing, 6) AS score, round(citing, 6) >= 0.6 AS passed FROM s"),
    "stage_policy": (
        policy,
        _SCORED
        + """, k AS (SELECT conv_id, turn, list_filter(kinds || [CASE WHEN regexp_matches(response, '(?i)\\bsource \\d') THEN 'names_source' END, CASE WHEN NOT contains(lower(response), 'the') THEN 'terse' END,
  CASE WHEN contains(lower(response), 'mail') THEN 'no_mail' END], lambda k: k IS NOT NULL) AS all_kinds FROM s),
y AS (SELECT *, list_transform(all_kinds, lambda k: CASE WHEN k IN ('violence', 'security') THEN 1.0 WHEN k = 'terse' THEN 0.2 WHEN k = 'names_source' THEN 0.4 WHEN k = 'no_mail' THEN 0.5 ELSE 0.8 END) AS weights FROM k)
SELECT conv_id, turn, array_to_string(list_sort(all_kinds), ',') AS kinds, round(CASE WHEN len(weights) = 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(weights) / len(weights)) END, 6) AS score, coalesce(list_max(weights), 0) < 0.8 AS passed FROM y""",
    ),
    "stage_rejection": (
        rejection,
        ANSWERS.rstrip() + f", n AS (SELECT *, {_COUNT} AS n FROM answers) SELECT conv_id, turn, CASE WHEN n >= 2 OR (n >= 1 AND length(response) < 100) THEN 'reject' WHEN n >= 1 AND length(response) > 200 THEN 'partial' ELSE 'answer' END AS behaviour FROM n",
    ),
    "stage_source_policy": (source_policy, _QUOTING),
    "pack_rag_score": (pack_scores, _SCORED + f"SELECT conv_id, turn, round({_MEAN}, 6) AS score, gate AND round({_PLAIN}, 6) >= 0.3 AS passed, gate AND {_PASSES.format(0.35)} AS overall_passed FROM w"),
    "pack_retrieval": (pack_retrieval, _SCORED + "SELECT conv_id, turn, round(0.6 * retrieving + 0.4 * relevant, 6) AS score, round(retrieving, 6) >= 0.5 AS passed FROM w"),
    "pack_faithfulness": (pack_faithfulness, _SCORED + "SELECT conv_id, turn, round(faithful, 6) AS score, round(faithful, 6) >= 0.4 AS passed FROM s"),
    "provider_thresholds": (
        provider_thresholds,
        _SCORED
        + """SELECT ['openai', 'anthropic', 'other'][conv_id % 3 + 1] AS provider, count(*) FILTER (round(retrieving, 6) >= 0.5) AS retrieval,
  count(*) FILTER (round(relevant, 6) >= CASE conv_id % 3 WHEN 0 THEN 0.25 ELSE 0.35 END) AS context_relevance, count(*) FILTER (round(faithful, 6) >= 0.4) AS faithfulness,
  count(*) FILTER (round(answering, 6) >= 0.5) AS answer_relevance, count(*) FILTER (round(citing, 6) >= 0.6) AS citation FROM w GROUP BY 1""",
    ),
    "semantics_score": (
        semantics_score,
        "WITH s AS (SELECT l_orderkey, l_linenumber, 0.4 * CAST(1 - CAST(l_discount AS DECIMAL(12,4)) AS DECIMAL(12,4)) + 0.3 * (1 - CAST(l_tax AS DECIMAL(12,4))) + 0.006 * CAST(l_quantity AS DECIMAL(12,4)) AS score FROM lineitem) "
        "SELECT l_orderkey, l_linenumber, CAST(round(score, 6) AS DOUBLE) AS score, round(score, 6) >= 0.7 AS passed FROM s",
    ),
    "pii_detect": (pii_counts, "SELECT lang, " + ", ".join(f"CAST(sum(len(regexp_extract_all(text, '{_rx(p)}'))) AS BIGINT) AS {k}" for p, k in G.PII) + " FROM documents GROUP BY 1"),
    "ngram_overlap": (
        ngram_overlap,
        f"WITH d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM (SELECT doc_id, {_words('text')} AS w FROM documents)), "
        f"b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM (SELECT item_id, {_words('text')} AS w FROM benchmark)) "
        "SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (run) GROUP BY 1, 2",
    ),
    "testcase_hash": (content_hash, "SELECT substr(sha256(text), 1, 16) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1"),
}
