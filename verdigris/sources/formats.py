"""Reading other formats into entity, filing, field-code and test-case rows, and writing exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import entity_text as T

#: Columns of the legal-entity CSV, and header words of Markdown tables.
_LEI = {"LEI": "lei", "Entity.LegalName": "primary_name", "Entity.LegalAddress.Country": "country_code", "Entity.LegalAddress.Region": "region", "Entity.LegalAddress.City": "city", "Entity.EntityCategory": "entity_category", "Entity.EntityStatus": "status"}
_HEADERS = ("natural language", "---", "metric", "expression")


def read_entities_csv(spark: SparkSession, path: str, include_inactive: bool = False) -> DataFrame:
    """Legal entities from CSV, plain or gzipped: blank names and, unless asked for, inactive ones are left out."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    clean = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    rows = raw.select(*[clean(c).alias(n) for c, n in _LEI.items()])
    active = F.upper("status") == "ACTIVE"
    out = rows.where(F.col("primary_name") != "")
    if not include_inactive:
        out = out.where(active)
    return out.select(
        F.upper("lei").alias("lei"), "primary_name", F.upper("country_code").alias("country_code"), "region", "city", F.lower("entity_category").alias("entity_category"), F.when(active, "active").otherwise("inactive").alias("entity_status"), F.lit("gleif").alias("data_source")
    )


def entities_from_map(json: DataFrame, column: str, exchanges: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """Entities from a JSON object whose values are {cik_str, ticker, title}; exchanges: (ticker, exchange). Values without a
    title are left out."""
    rows = json.select(F.explode(F.map_values(F.from_json(column, "map<string,struct<cik_str:string,ticker:string,title:string>>"))).alias("e"))
    named = rows.select(T.cik(F.col("e.cik_str")).alias("cik"), F.upper(F.trim(F.coalesce("e.ticker", F.lit("")))).alias("ticker"), F.trim("e.title").alias("primary_name")).where("primary_name <> ''")
    joined = named.join(exchanges, "ticker", "left")
    return joined.select("cik", "ticker", "primary_name", T.ric(F.col("ticker"), F.col("exchange"), suffixes).alias("ric"), "exchange")


def filings_from_columns(json: DataFrame, key: str, column: str, forms: list[str], after: str | None = None) -> DataFrame:
    """Filings from parallel arrays of one JSON object, matched by position: only the given forms, with a primary document,
    filed on or after a day; a missing report date is the filing date."""
    schema = "accessionNumber array<string>, form array<string>, filingDate array<string>, reportDate array<string>, primaryDocument array<string>"
    parsed = json.select(key, F.from_json(column, schema).alias("j"))
    zipped = parsed.select(key, F.inline(F.arrays_zip("j.accessionNumber", "j.form", "j.filingDate", "j.reportDate", "j.primaryDocument")))
    rows = zipped.select(key, F.col("accessionNumber").alias("accession"), "form", F.try_to_date("filingDate").alias("filed"), F.coalesce(F.try_to_date(F.nullif("reportDate", F.lit(""))), F.try_to_date("filingDate")).alias("period"), F.col("primaryDocument").alias("document"))
    rows = rows.where(F.col("form").isin(*forms) & (F.coalesce("document", F.lit("")) != ""))
    return rows if after is None else rows.where(F.col("filed") >= F.lit(after).cast("date"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_html(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, html, and the folder's partition columns) of whole files: bytes that are no UTF-8 become replacement characters.
    Empty files give no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("html"), *[c for c in files.columns if c not in ("path", "modificationTime", "length", "content")])


#: What ends a page in a file of many, and what stands for it and for itself within a page.
_END, _ESCAPE = "\x1e", "\x1b"


def write_pages(pages: DataFrame, key: str, html: str, path: str) -> None:
    """Pages as text files of many each, as one file a page costs more than the page: the key, a line break and the html, whose
    bytes stay as they are, but for record separators and escapes, which are escaped."""
    body = F.replace(F.replace(F.col(html), F.lit(_ESCAPE), F.lit(f"{_ESCAPE}0")), F.lit(_END), F.lit(f"{_ESCAPE}1"))
    page = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\n"), body)
    pages.where(F.col(html).isNotNull()).select(page.alias("value")).write.option("lineSep", _END).text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(key string, html) of files by ``write_pages``, a page at a time: bytes that are no UTF-8 become replacement characters."""
    page = spark.read.option("lineSep", _END).text(path).select(F.make_valid_utf8("value").alias("value"))
    at = F.instr("value", "\n")
    body = F.replace(F.replace(F.substr("value", at + 1), F.lit(f"{_ESCAPE}1"), F.lit(_END)), F.lit(f"{_ESCAPE}0"), F.lit(_ESCAPE))
    return page.where("value <> ''").select(F.nullif(F.substr("value", F.lit(1), at - 1), F.lit("")).alias("key"), body.alias("html"))


def field_codes(markdown: Column) -> Column:
    """Array of struct(hints, code, description) from the rows | words | `code` | description | of Markdown tables."""
    pattern = F.lit(r"\|\s*([^|]+?)\s*\|\s*`([^`]+)`\s*\|\s*([^|]+?)\s*\|")
    zipped = F.arrays_zip(*[F.regexp_extract_all(markdown, pattern, i).alias(n) for i, n in ((1, "hint"), (2, "code"), (3, "description"))])
    kept = F.filter(zipped, lambda r: ~F.lower(r["hint"]).isin(*_HEADERS))
    return F.transform(kept, lambda r: F.struct(F.transform(F.split(r["hint"], ","), lambda h: F.trim(h)).alias("hints"), r["code"].alias("code"), r["description"].alias("description")))


def query_examples(markdown: Column) -> Column:
    """Array of struct(query, call, complexity) from numbered questions followed by a Python block; the complexity is the
    highest level named before the question."""
    pattern = r'(?s)\*\*Q\d+:\*\*\s*"([^"]+)"\s*```python\s*(get_data\([^`]+?)\s*```'
    queries, calls = (F.regexp_extract_all(markdown, F.lit(pattern), i) for i in (1, 2))
    before = lambda q: F.call_function("substring_index", markdown, F.concat(F.lit('"'), q, F.lit('"')), F.lit(1))
    levels = lambda q: F.transform(F.regexp_extract_all(before(q), F.lit(r"Level ([1-5])"), 1), lambda x: x.cast("int"))
    return F.zip_with(queries, calls, lambda q, c: F.struct(F.trim(q).alias("query"), c.alias("call"), F.coalesce(F.array_max(levels(q)), F.lit(1)).alias("complexity")))


def fixture_cases(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of {_meta, test_cases[]} files: id, query, relevant ids, behaviour, whether citations are required."""
    schema = "test_cases array<struct<id:string,query:string,input:struct<query:string>,category:string,relevant_chunk_ids:array<string>,expected:struct<relevant_docs:array<string>,behavior:string,requires_citations:boolean,requires_citation:boolean>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("test_cases").alias("t"))
    return rows.select(
        F.col("t.id").alias("id"), F.coalesce("t.input.query", "t.query").alias("query"), F.coalesce("t.expected.relevant_docs", "t.relevant_chunk_ids", F.array().cast("array<string>")).alias("relevant"),
        F.col("t.expected.behavior").alias("behaviour"), F.coalesce("t.expected.requires_citations", "t.expected.requires_citation", F.lit(True)).alias("requires_citations"), F.col("t.category").alias("category"),
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nulls are blank."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
