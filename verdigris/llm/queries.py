"""The thin queries over the operators of this subpackage, with the parameters they run with in production."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import decontaminate, html_text, language, mixing, near_dup, packing, quality, runs, sharding, toxicity, url_filter, variants, warc

URL_RULES = [
    url_filter.Rule("com", "/en/", "block"),
    url_filter.Rule("example.com", "/en/7", "allow"),
    url_filter.Rule("net", "/de/", "allow"),
    url_filter.Rule("example.net", "/de/8", "block"),
    url_filter.Rule("org", "/es/", "block"),
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, folder, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, folder, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, folder, "documents"), forest=near_dup.Forest(width=4))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_documents(_table(spark, folder, "documents"), (5.0, 2.0, 1.0), 1.5, 2.0)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    shown = html_text.extract_text(_table(spark, folder, "pages").select("page_id", "html"))
    return shown.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.rate(docs, quality.train(docs, _table(spark, folder, "labels")))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = language.predict(docs, language.train(docs.where(~held)), ["doc_id"])
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    labels = _table(spark, folder, "labels").where(toxicity.learnable())
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(~toxicity.learnable(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.archive(_table(spark, folder, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def lose_letter(doc: int | None, run: str) -> str:
    """One run in 31, by a hash of document and run, without one of its letters; a null id is hashed as an empty text."""
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    return run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    found = variants.variant_groups(_table(spark, folder, "documents"), change=lose_letter)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def go_round(doc: int | None, ids: np.ndarray) -> np.ndarray:
    """In one document of ten, by a hash of its id, the words from some place on go round; a null id changes nothing."""
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not len(ids):
        return ids
    g, n = h // 10, len(ids)
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return np.concatenate((ids[:first], ids[first + np.arange(n - first) % period]))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.periodic_runs(_table(spark, folder, "documents"), change=go_round)
    greatest = F.reduce("runs", F.element_at("runs", 1), lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best))
    line = lambda r: F.concat_ws(",", r.start, r.length, r.period)
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", F.when(F.size("runs") > 0, greatest))
    return best.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


QUERIES = (op1_url_filter, op2_sharding, op3_near_dup, op4_mixing, op5_html_text, op6_quality, op7_language, op8_toxicity, op9_decontamination, op10_warc, op11_spelling_variants, op12_periodic_runs, op13_packing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}


def _url_sql() -> str:
    """The rules one by one: of those that fit, the longest."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ranked = sorted(URL_RULES, key=lambda r: -len(r.text))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in ranked)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ranked)
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM split"""


_WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND head <> page_id THEN head END AS refers_to
FROM h"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _url_sql(), "op10_warc": _WARC_SQL}
