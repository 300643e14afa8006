"""Queries on other formats, validation and routing, over rows put together from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import routing
from verdigris.operators import validation
from verdigris.sources import formats
from verdigris.sources.tables import table


def json_map(spark: SparkSession, folder: str) -> DataFrame:
    """Maps of some hundred companies each, as JSON texts."""
    c = table(spark, folder, "customer").select("c_mktsegment", F.col("c_custkey").cast("string").alias("k"), F.struct(F.col("c_custkey").alias("cik_str"), F.concat(F.lit(" tk"), F.col("c_custkey").cast("string")).alias("ticker"), F.when(F.col("c_custkey") % 10 == 3, " ").otherwise(F.col("c_name")).alias("title")).alias("v"))
    maps = c.groupBy(F.floor(F.col("k").cast("long") / 256)).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("j"))
    exchanges = table(spark, folder, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("TK"), F.col("c_custkey").cast("string")).alias("ticker"), F.lit("NYSE").alias("exchange"))
    return formats.entities_from_map(maps, "j", exchanges, {"NYSE": ".N"})


def json_columnar(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's orders as parallel arrays, read back as filings."""
    o = table(spark, folder, "orders")
    row = F.struct("o_orderkey", F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    arr = lambda f: F.transform("r", f)
    j = F.to_json(
        F.struct(
            arr(lambda x: x["o_orderkey"].cast("string")).alias("accessionNumber"), arr(lambda x: x["form"]).alias("form"), arr(lambda x: x["d"]).alias("filingDate"),
            arr(lambda x: F.when(x["o_orderkey"] % 2 == 0, "").otherwise("1999-12-31")).alias("reportDate"), arr(lambda x: F.when(x["o_orderkey"] % 7 == 0, "").otherwise("d.htm")).alias("primaryDocument"),
        )
    )
    out = formats.filings_from_columns(g.select("o_custkey", j.alias("j")), "o_custkey", "j", ["10-K", "10-Q"], "1997-01-01")
    return out.select("o_custkey", F.col("accession").cast("long").alias("o_orderkey"), "form", "filed", "period")


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of field codes of some hundred rows each, as Markdown texts."""
    p = table(spark, folder, "part").groupBy("p_type", F.floor(F.col("p_partkey") / 1024)).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("| "), F.col("p_name"), F.lit(", "), F.col("p_brand"), F.lit(" | `TR."), F.col("p_partkey").cast("string"), F.lit("` | size "), F.col("p_size").cast("string"), F.lit(" |\n")))), "").alias("rows"))
    text = F.concat(F.lit("# Codes\n| Natural language | `TR Code` | Description |\n|---|---|---|\n"), "rows")
    codes = p.select(F.explode(formats.field_codes(text)).alias("r"))
    return codes.select(F.array_join("r.hints", "+").alias("hints"), "r.code", "r.description")


def markdown_qa(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "region").select("r_regionkey", F.concat(F.lit("## Level 2\n**Q1:** \"first of "), "r_name", F.lit("\"\n```python\nget_data(1)\n```\n## Level 4\n**Q2:** \"second of "), "r_name", F.lit("\" ```python get_data(\n 2) ```\n"))  .alias("md"))
    q = b.select("r_regionkey", F.explode(formats.query_examples(F.col("md"))).alias("e"))
    return q.select("r_regionkey", "e.query", F.regexp_replace("e.call", r"\s+", "").alias("call"), "e.complexity")


def entity_validate(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    k = F.col("c_custkey")
    rows = c.select(
        "c_custkey", F.when(k % 3 == 0, F.rpad(F.lit("lei"), 20, "7")).when(k % 3 == 1, "short").alias("lei"), k.cast("string").alias("cik"), F.when(k % 4 == 0, "BBG000000001").when(k % 4 == 1, "BBX").alias("figi"), F.when(k % 5 == 0, "toolongticker").otherwise("AB.C").alias("ticker"),
        F.when(k % 6 == 0, "XX").otherwise("us").alias("country_code"), F.when(k % 7 == 0, "").when(k % 7 == 1, "n/a").otherwise(F.col("c_name")).alias("primary_name"), F.when(k % 11 != 0, "crm").alias("data_source"),
    )
    out = validation.validate_entities(rows, ["US", "GB", "DE"])
    return out.select("c_custkey", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "valid")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of three phrases, which follow from the order's keys, price and priority."""
    o = table(spark, folder, "orders")
    pick = lambda n: F.element_at(F.array(*[F.lit(t) for t in _PHRASES]), (n % len(_PHRASES) + 1).cast("int"))
    q = F.concat_ws(" ", pick(F.col("o_orderkey")), pick(F.col("o_custkey") * 7 + F.col("o_orderkey")), F.lower("o_orderpriority"), pick(F.floor("o_totalprice").cast("long")))
    return o.select("o_orderkey", q.alias("q"))


#: With words of all domains, times, fields and periods, and with words that hold shorter ones.
_PHRASES = (
    "Top 10 tech stocks with PE below 15", "closing price history of Acme, weekly", "market cap and dividend yield", "for the past 3 years", "tell me a story", "ohlc quotes", "for the last 6 months",
    "consensus EPS estimate next quarter", "analyst recommendation", "net income and gross margin", "last quarter", "fiscal year", "who is the CEO", "board size", "free cash flow per share",
    "book value per share fy2", "find undervalued", "yesterday", "quarterly", "in three years", "ytd", "profitable", "monthly", "return on equity", "long term growth", "earnings surprise",
)


def domain_route(spark: SparkSession, folder: str) -> DataFrame:
    r = routing.route(routing.domain_scores(F.col("q")))
    return _questions(spark, folder).select("o_orderkey", r["domain"].alias("domain"), r["score"].alias("score"))


def time_range(spark: SparkSession, folder: str) -> DataFrame:
    t = routing.time_range(F.col("q"))
    return _questions(spark, folder).select("o_orderkey", t["start"].alias("start"), t["end"].alias("end"), t["freq"].alias("freq"))


def fields_detect(spark: SparkSession, folder: str) -> DataFrame:
    tables = [{"price": "P", "closing price": "PC"}, {"market cap": "MV"}, {"dividend": "D", "dividend yield": "DY"}]
    return _questions(spark, folder).select("o_orderkey", F.array_join(routing.fields(F.col("q"), tables), ",").alias("fields"))


def fields_wordbound(spark: SparkSession, folder: str) -> DataFrame:
    return _questions(spark, folder).select("o_orderkey", F.array_join(routing.named_fields(F.col("q"), routing.ESTIMATE_FIELDS), ",").alias("fields"))


def period_detect(spark: SparkSession, folder: str) -> DataFrame:
    f = routing.fundamental_period(F.col("q"))
    return _questions(spark, folder).select("o_orderkey", routing.estimate_period(F.col("q")).alias("estimate"), f["start"].alias("start"), f["end"].alias("end"), f["period"].alias("period"), f["freq"].alias("freq"))


_LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in _PHRASES) + "]"
_ASKED = f"""
WITH q AS (SELECT o_orderkey, lower({_LIST}[o_orderkey % {len(_PHRASES)} + 1] || ' ' || {_LIST}[(o_custkey * 7 + o_orderkey) % {len(_PHRASES)} + 1] || ' ' || o_orderpriority || ' ' || {_LIST}[CAST(floor(o_totalprice) AS BIGINT) % {len(_PHRASES)} + 1]) AS q FROM orders)
"""
_has = lambda phrases: "(" + " OR ".join(f"contains(q, '{p}')" for p in phrases) + ")"
_n_hits = lambda words: " + ".join(f"CAST(contains(q, '{w}') AS INT)" for w in words)


def _domain_sql() -> str:
    """Counts of words, scores of them, and the first domain with the best score."""
    words = {"price": routing.PRICE_WORDS, "estimates": routing.ESTIMATE_WORDS, "fundamentals": routing.FUNDAMENTAL_WORDS, "officers": routing.OFFICER_WORDS}
    counts = ", ".join(f"{_n_hits(w)} AS n_{name}" for name, w in words.items())
    scored = ", ".join(f"[0.0, 0.5, 0.7, 0.9][least(n_{name}, 3) + 1] AS {name}" for name in words)
    screen = f"{_n_hits(routing.SCREEN_WORDS)} + CASE WHEN {_has(routing.SCREEN_BOOST)} THEN 2 ELSE 0 END"
    return (
        _ASKED.rstrip()
        + f""", n AS (SELECT o_orderkey, {counts}, {screen} AS n_screening FROM q), s AS (SELECT o_orderkey, {scored}, [0.0, 0.5, 0.7, 0.8, 0.9][least(n_screening, 4) + 1] AS screening FROM n),
b AS (SELECT *, greatest({", ".join(words)}, screening) AS best FROM s)
SELECT o_orderkey, CASE WHEN best < 0.7 THEN 'unknown' {" ".join(f"WHEN {name} = best THEN '{name}'" for name in words)} ELSE 'screening' END AS domain, CAST(best AS DOUBLE) AS score FROM b"""
    )


def _range_sql() -> str:
    value = lambda p, text: f"'{text.partition('{}')[0]}' || regexp_extract(q, '{p}', 1) || '{text.partition('{}')[2]}'" if "{}" in text else f"'{text}'"
    case = lambda k: "CASE " + " ".join(f"WHEN regexp_matches(q, '{r[0]}') THEN {'NULL' if r[k] is None else value(r[0], r[k])}" for r in routing.TIME_RANGES) + " END"
    named = "CASE WHEN contains(q, 'weekly') THEN 'W' WHEN contains(q, 'monthly') THEN 'M' WHEN contains(q, 'quarterly') THEN 'Q' WHEN regexp_matches(q, 'annual|yearly') THEN 'Y' END"
    return _ASKED + f'SELECT o_orderkey, {case(1)} AS start, {case(2)} AS "end", coalesce({named}, {case(3)}) AS freq FROM q'


_FIELDS_SQL = _ASKED + """, f AS (SELECT o_orderkey, list_filter([CASE WHEN contains(q, 'closing price') THEN 'PC' WHEN contains(q, 'price') THEN 'P' END, CASE WHEN contains(q, 'market cap') THEN 'MV' END,
  CASE WHEN contains(q, 'dividend yield') THEN 'DY' WHEN contains(q, 'dividend') THEN 'D' END], lambda x: x IS NOT NULL) AS f FROM q)
SELECT o_orderkey, CASE WHEN len(f) = 0 THEN 'P' ELSE array_to_string(f, ',') END AS fields FROM f"""
_PERIOD_SQL = _ASKED + f"""SELECT o_orderkey, CASE {" ".join(f"WHEN {_has(phrases)} THEN '{period}'" for period, phrases in routing.ESTIMATE_PERIODS)} ELSE 'FY1' END AS estimate,
  CASE WHEN years IS NOT NULL THEN '0' END AS start, '-' || (years - 1) AS "end",
  CASE WHEN years IS NOT NULL THEN NULL WHEN quarterly THEN CASE WHEN {_has(("last quarter", "previous quarter"))} THEN 'FQ-1' ELSE 'FQ0' END ELSE 'FY0' END AS period,
  CASE WHEN years IS NOT NULL THEN 'FY' WHEN quarterly THEN 'FQ' WHEN {_has(("last year", "fiscal year"))} THEN 'FY' END AS freq
FROM (SELECT *, TRY_CAST(regexp_extract(q, '(?:last|past)\\s+(\\d+)\\s+years?', 1) AS BIGINT) AS years, {_has(("quarter", "q1", "q2", "q3", "q4"))} AS quarterly FROM q)"""


def _wordbound_sql() -> str:
    ordered = sorted(routing.ESTIMATE_FIELDS, key=lambda phrase: -len(phrase))
    found = ", ".join(f"CASE WHEN regexp_matches(q, '\\b{p}\\b') THEN '{routing.ESTIMATE_FIELDS[p]}' END" for p in ordered)
    return _ASKED.rstrip() + f""", f AS (SELECT o_orderkey, list_filter([{found}], lambda x: x IS NOT NULL) AS f FROM q)
SELECT o_orderkey, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ',') AS fields FROM f"""


QUERIES = {
    "src_json_map": (json_map, "SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, 'TK' || c_custkey AS ticker, c_name AS primary_name, 'TK' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.N' ELSE '.O' END AS ric, CASE WHEN c_custkey % 2 = 0 THEN 'NYSE' END AS exchange FROM customer WHERE c_custkey % 10 <> 3"),
    "src_json_columnar": (json_columnar, "SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN '10-K' ELSE '10-Q' END AS form, CAST(o_orderdate AS DATE) AS filed, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE DATE '1999-12-31' END AS period FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 7 <> 0 AND o_orderdate >= '1997-01-01'"),
    "src_markdown": (markdown, "SELECT p_name || '+' || p_brand AS hints, 'TR.' || p_partkey AS code, 'size ' || p_size AS description FROM part"),
    "src_markdown_qa": (markdown_qa, "SELECT r_regionkey, 'first of ' || r_name AS query, 'get_data(1)' AS call, 2 AS complexity FROM region UNION ALL SELECT r_regionkey, 'second of ' || r_name, 'get_data(2)', 4 FROM region"),
    "entity_validate": (
        entity_validate,
        "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 7 = 0 THEN 'no_name' END, CASE WHEN c_custkey % 11 = 0 THEN 'no_source' END, CASE WHEN c_custkey % 3 = 1 THEN 'lei' END) AS errors, concat_ws(',', CASE WHEN c_custkey % 4 = 1 THEN 'figi' END, CASE WHEN c_custkey % 5 = 0 THEN 'ticker' END, CASE WHEN c_custkey % 6 = 0 THEN 'country' END, CASE WHEN c_custkey % 7 = 1 THEN 'placeholder' END) AS warnings, c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 3 <> 1 AS valid FROM customer",
    ),
    "domain_route": (domain_route, _domain_sql()),
    "time_range_detect": (time_range, _range_sql()),
    "fields_detect": (fields_detect, _FIELDS_SQL),
    "fields_detect_wordbound": (fields_wordbound, _wordbound_sql()),
    "period_detect": (period_detect, _PERIOD_SQL),
}
