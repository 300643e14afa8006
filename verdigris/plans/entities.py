"""Queries over entities, which customers, suppliers and parts stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import entity_text as T
from verdigris.functions import similarity as S
from verdigris.operators import aggregates as A
from verdigris.operators import entities as E
from verdigris.sources.tables import table


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as entities: a company name, a ticker, a code, a source."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("eid"),
        F.concat_ws(" ", F.initcap("p_name"), F.col("p_brand"), F.when(F.col("p_size") % 3 == 0, "Inc.").when(F.col("p_size") % 3 == 1, "& Co").otherwise("Ltd")).alias("name"),
        F.concat(F.upper(F.substring("p_name", 1, 2)), F.col("p_partkey").cast("string")).alias("ticker"),
        F.col("p_type").alias("source"),
        (F.col("p_size") > 5).alias("active"),
        F.col("p_retailprice").alias("price"),
    )


PARTS = """
WITH parts AS (
  SELECT p_partkey AS eid,
    upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2)
      || ' ' || p_brand || ' ' || CASE p_size % 3 WHEN 0 THEN 'Inc.' WHEN 1 THEN '& Co' ELSE 'Ltd' END AS name,
    upper(substr(p_name, 1, 2)) || p_partkey AS ticker, p_type AS source, p_size > 5 AS active, p_retailprice AS price FROM part)
"""


def alias_rows(spark: SparkSession, folder: str) -> DataFrame:
    p = parts(spark, folder)
    return p.select("eid", F.explode(T.aliases(F.col("name"), F.col("ticker"))).alias("alias"))


_NORMAL = r"trim(regexp_replace(lower(name), '\s*(&\s*(co\.?|company))?\s*(inc\.?|corp\.?|ltd\.?|llc|plc)?\.?$', ''))"
ALIASES = PARTS.rstrip() + f""",
forms AS (
  SELECT eid, unnest([lower(name), {_NORMAL}, trim(lower(regexp_replace(name, '[^\\w\\s]', '', 'g'))), lower(ticker),
    CASE WHEN len(string_split(name, ' ')) >= 3 THEN lower(array_to_string(list_filter(list_transform(string_split(name, ' '), lambda w: substr(w, 1, 1)), lambda c: regexp_matches(c, '^[A-Z]$')), '')) END]) AS alias FROM parts),
aliases AS (SELECT DISTINCT eid, alias FROM forms WHERE length(alias) >= 2)
"""


def normalized(spark: SparkSession, folder: str) -> DataFrame:
    return parts(spark, folder).select("eid", T.normalize(F.col("name")).alias("normal"))


def codes(spark: SparkSession, folder: str) -> DataFrame:
    exchanges = {"NYSE": ".N", "LSE": ".L", "PROMO": ".P", "ECONOMY": ".E"}
    return parts(spark, folder).select("eid", T.ric(F.col("ticker"), F.col("source"), exchanges).alias("ric"), T.cik(F.col("eid")).alias("cik"))


def ambiguous_alias(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return A.ambiguous(p, F.lower("p_name"), "p_partkey", "p_brand")


def ticker_collision(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.groupBy("p_name").agg(F.countDistinct("p_type").alias("n_types"), F.min("p_partkey").alias("first")).where("n_types > 1")


def entity_stats(spark: SparkSession, folder: str) -> DataFrame:
    p = parts(spark, folder).where("active")
    return p.agg(F.count("*").alias("total"), F.count_if(F.col("price") > 1000).alias("dear"), F.countDistinct("source").alias("sources"), F.countDistinct("name").alias("names"), F.countDistinct("ticker").alias("tickers"))


def entity_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return A.coverage(parts(spark, folder), "source", {"with_price": F.col("price") > 1000, "live": F.col("active")})


def source_counts(spark: SparkSession, folder: str) -> DataFrame:
    return parts(spark, folder).groupBy("source").agg(F.count("*").alias("n"), F.count_if("active").alias("live")).orderBy(F.desc("n"), "source")


def alias_entity(spark: SparkSession, folder: str) -> DataFrame:
    joined = alias_rows(spark, folder).join(parts(spark, folder).where("active").select("eid", "name"), "eid")
    return joined.select("alias", "eid", "name")


def without_alias(spark: SparkSession, folder: str) -> DataFrame:
    """Customers that never ordered, as entities without aliases."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return E.anti(customers, table(spark, folder, "orders").select(F.col("o_custkey").alias("k")), "k")


def semi_set(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").join(orders, "c_custkey", "left_semi").select("c_custkey", "c_name")


def lookup_enrich(spark: SparkSession, folder: str) -> DataFrame:
    cards = table(spark, folder, "lineitem").where("l_discount > 0.08").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return cards.join(table(spark, folder, "part").select("p_partkey", "p_name"), "p_partkey", "left").select("l_orderkey", "l_linenumber", "p_name")


def ticker_exchange(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, folder, "supplier").join(nation, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.lit("OTC")).alias("exchange"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Misspelt part names, tickers and aliases."""
    p = parts(spark, folder)
    typo = F.concat(F.substring("name", 1, 3), F.lower(F.substr("name", F.lit(5))))
    return p.select(F.col("eid").alias("qid"), F.when(F.col("eid") % 3 == 0, typo).when(F.col("eid") % 3 == 1, F.col("ticker")).otherwise(F.concat(T.normalize(F.col("name")), F.lit(""))).alias("query"))


QUESTIONS = ALIASES.rstrip() + f""",
questions AS (
  SELECT eid AS qid, CASE eid % 3 WHEN 0 THEN substr(name, 1, 3) || lower(substr(name, 5)) WHEN 1 THEN ticker ELSE {_NORMAL} END AS query FROM parts)
"""
_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


#: From which trigram similarity names are alike.
LEAST = 0.3


def trigram_topk(spark: SparkSession, folder: str) -> DataFrame:
    names = parts(spark, folder).select("eid", "name")
    return E.trigram_pairs(questions(spark, folder), names, LEAST, 6)


def resolve_tiers(spark: SparkSession, folder: str) -> DataFrame:
    p = parts(spark, folder).withColumn("ric", T.ric(F.col("ticker"), F.col("source"), {}))
    return E.resolve(questions(spark, folder), p, alias_rows(spark, folder), LEAST)


def resolve_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Some parts have no code; every seventh query is cut to three letters."""
    p = parts(spark, folder).withColumn("ric", F.when(F.col("eid") % 9 != 0, T.ric(F.col("ticker"), F.col("source"), {})))
    kind = F.when(F.col("alias") == F.lower("ticker"), "ticker").when(F.col("alias") == F.lower("name"), "legal_name").otherwise("generated")
    a = alias_rows(spark, folder).join(parts(spark, folder).select("eid", "name", "ticker"), "eid").select("eid", "alias", kind.alias("alias_type"))
    q = questions(spark, folder).where("qid % 20 = 0").withColumn("query", F.when(F.col("qid") % 7 == 0, F.substring("query", 1, 3)).otherwise(F.col("query")))
    return E.resolve_by_cascade(q, p, a, LEAST)


def extract_names(spark: SparkSession, folder: str) -> DataFrame:
    p = parts(spark, folder)
    question = F.concat(F.lit("What is "), F.col("name"), F.lit("'s revenue, and how did "), F.col("ticker"), F.lit(" compare with globex earnings?"))
    return p.select("eid", F.array_join(T.extract(question, ["what", "how"]), "|").alias("found"))



def _extract_sql() -> str:
    """Four lists of candidates one after the other; of those with one key the first stays."""
    cap, tick, poss, term = (p.replace("'", "''") for p in (T._CAPITALISED, T._TICKER, T._POSSESSIVE, T._BEFORE_TERM))
    no = ", ".join(f"'{t}'" for t in T.NO_TICKERS)
    return rf"""{PARTS.rstrip()},
q AS (SELECT eid, 'What is ' || name || '''s revenue, and how did ' || ticker || ' compare with globex earnings?' AS q FROM parts),
f AS (SELECT eid, list_concat(list_concat(regexp_extract_all(q, '{cap}', 1), list_filter(regexp_extract_all(q, '{tick}', 1), lambda t: t NOT IN ({no}))),
  list_transform(list_concat(regexp_extract_all(q, '{poss}', 1), regexp_extract_all(q, '{term}', 1)), lambda w: upper(w[1]) || lower(w[2:]))) AS found FROM q),
k AS (SELECT eid, list_transform(found, lambda n: {{'k': trim(regexp_replace(trim(lower(n)), '\s+(inc\.?|corp\.?|ltd\.?|llc|plc)$', '')), 'n': n}}) AS named FROM f),
u AS (SELECT eid, list_filter(named, lambda s: length(s.k) >= 2 AND s.k NOT IN ('what', 'how') AND trim(lower(s.n)) NOT IN ('what', 'how')) AS u FROM k)
SELECT eid, array_to_string(list_transform(list_filter(u, lambda s, i: list_position(list_transform(u, lambda x: x.k), s.k) = i), lambda s: s.n), '|') AS found FROM u"""


QUERIES = {
    "entity_normalize": (normalized, PARTS + f"SELECT eid, {_NORMAL} AS normal FROM parts"),
    "alias_generate": (alias_rows, ALIASES + "SELECT eid, alias FROM aliases"),
    "ric_generate": (codes, PARTS + "SELECT eid, ticker || CASE source WHEN 'PROMO' THEN '.P' WHEN 'ECONOMY' THEN '.E' ELSE '.O' END AS ric, lpad(CAST(eid AS VARCHAR), 10, '0') AS cik FROM parts"),
    "agg_ambiguous_alias": (ambiguous_alias, "SELECT lower(p_name) AS key, count(DISTINCT p_partkey) AS n, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS shown, min(p_brand) AS first FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1"),
    "agg_ticker_collision": (ticker_collision, "SELECT p_name, count(DISTINCT p_type) AS n_types, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1"),
    "view_entity_stats": (entity_stats, PARTS + "SELECT count(*) AS total, count(*) FILTER (price > 1000) AS dear, count(DISTINCT source) AS sources, count(DISTINCT name) AS names, count(DISTINCT ticker) AS tickers FROM parts WHERE active"),
    "view_entity_coverage": (
        entity_coverage,
        PARTS + "SELECT source, count(*) AS total, count(*) FILTER (price > 1000) AS with_price, round(100.0 * count(*) FILTER (price > 1000) / nullif(count(*), 0), 2) AS with_price_pct, count(*) FILTER (active) AS live, round(100.0 * count(*) FILTER (active) / nullif(count(*), 0), 2) AS live_pct FROM parts GROUP BY 1",
    ),
    "source_counts": (source_counts, PARTS + "SELECT source, count(*) AS n, count(*) FILTER (active) AS live FROM parts GROUP BY 1"),
    "join_alias_entity": (alias_entity, ALIASES + "SELECT alias, eid, name FROM aliases JOIN parts USING (eid) WHERE active"),
    "join_anti_not_exists": (without_alias, "SELECT c_custkey AS k, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "join_semi_set": (semi_set, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "join_lookup_enrich": (lookup_enrich, "SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_discount > 0.08"),
    "join_ticker_exchange": (ticker_exchange, "SELECT s_suppkey, coalesce(n_name, 'OTC') AS exchange FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey"),
    "join_theta_trigram": (
        trigram_topk,
        QUESTIONS.rstrip()
        + f""",
q AS (SELECT qid, {_GRAMS.format('query')} AS g FROM questions), n AS (SELECT eid, {_GRAMS.format('name')} AS h FROM parts),
s AS (SELECT qid, eid, len(list_intersect(g, h)) AS common, len(g) + len(h) AS total FROM q, n)
SELECT qid, eid, round(common / (total - common), 6) AS similarity FROM s WHERE common / (total - common) > 0.3""",
    ),
    "entity_resolve_batch": (
        resolve_tiers,
        QUESTIONS.rstrip()
        + f""",
q AS (SELECT qid, trim(lower(query)) AS k FROM questions), live AS (SELECT * FROM parts WHERE active),
known AS (
  SELECT qid, a.eid, 1 AS tier, 1.0 AS sim FROM q JOIN aliases a ON a.alias = q.k JOIN live USING (eid)
  UNION ALL SELECT qid, eid, 2, 1.0 FROM q JOIN live ON lower(ticker) = k
  UNION ALL SELECT qid, eid, 3, 1.0 FROM q JOIN live ON lower(ticker || '.O') = k),
qg AS (SELECT qid, {_GRAMS.format('k')} AS g FROM q WHERE qid NOT IN (SELECT qid FROM known)),
ag AS (SELECT eid, {_GRAMS.format('alias')} AS h FROM aliases JOIN live USING (eid)),
s AS (SELECT qid, eid, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS sim FROM qg, ag),
everything AS (SELECT * FROM known UNION ALL SELECT qid, eid, 4, sim FROM s WHERE sim > 0.3)
SELECT qid, eid, tier, round(sim, 6) AS similarity FROM everything QUALIFY row_number() OVER (PARTITION BY qid ORDER BY tier, sim DESC, eid) = 1""",
    ),
    "entity_resolve_db": (
        resolve_cascade,
        QUESTIONS.rstrip()
        + f""",
q0 AS (SELECT qid, CASE WHEN qid % 7 = 0 THEN substr(query, 1, 3) ELSE query END AS name FROM questions WHERE qid % 20 = 0),
q AS (SELECT qid, name AS query, lower(name) AS low, {_NORMAL} AS normal FROM q0), coded AS (SELECT * FROM parts WHERE eid % 9 <> 0),
named AS (SELECT eid, alias, CASE WHEN alias = lower(ticker) THEN 0.99 WHEN alias = lower(name) THEN 0.98 ELSE 0.95 END AS sure FROM aliases JOIN coded USING (eid)),
known AS (
  SELECT qid, eid, 1 AS step, sure AS confidence FROM q JOIN named ON alias = normal UNION ALL SELECT qid, eid, 2, sure FROM q JOIN named ON alias = low
  UNION ALL SELECT qid, eid, 3, 0.95 FROM q JOIN coded ON lower(name) = low UNION ALL SELECT qid, eid, 4, 0.99 FROM q JOIN coded ON lower(ticker) = low),
qg AS (SELECT qid, {_GRAMS.format('query')} AS g FROM q WHERE length(query) >= 4 AND qid NOT IN (SELECT qid FROM known)), ng AS (SELECT eid, {_GRAMS.format('name')} AS h FROM coded),
s AS (SELECT qid, eid, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS sim FROM qg, ng),
everything AS (SELECT * FROM known UNION ALL SELECT qid, eid, 5, sim FROM s WHERE sim > 0.3)
SELECT qid, eid, step, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM everything QUALIFY row_number() OVER (PARTITION BY qid ORDER BY step, CASE WHEN step = 5 THEN confidence ELSE 0 END DESC, eid) = 1""",
    ),
    "entity_extract": (extract_names, _extract_sql()),
}
