"""A training corpus from raw documents: toxic documents go, near duplicates leave one of each group, benchmark passages
go, sources are mixed to weights, and the rest is cut into balanced shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Stages
drop documents by what they find in them and nothing else: null and empty texts pass until the mix, which takes copies of
words; documents with a null id pass every stage that needs an id to name a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import decontaminate, mixing, near_dup, scratch, sharding, toxicity

#: Documents whose score is this or more are toxic.
TOXIC = 0.5
SOURCE_WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
SHARDS = 24
#: Up to so many ids of dropped documents are sent to the texts; beyond, the texts are shuffled once.
SENT_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id isn't among ``ids`` (doc_id, distinct), which are written first, since they are read twice."""
    ids = scratch.materialize(ids, "dropped")
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(docs.columns)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier scores as toxic; it learns from the labelled documents outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(toxicity.learnable())
    model = toxicity.fit_toxicity(docs, labels)
    return toxicity.score_toxicity(docs, model, docs.columns, score_col="__toxicity").where(F.col("__toxicity") < TOXIC).select(docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keep the document with the smallest id."""
    groups = near_dup.near_duplicates(docs)
    extra = groups.where("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct()
    return _without(docs, extra)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, as it stands or with other numbers and names."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(docs, items).select("doc_id").distinct()
    return _without(docs, found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source gives its target; a document comes at most twice. Documents without
    an id are told apart by source and text; rows that repeat an id within a source fare alike."""
    known = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("source", "text")))
    mixed = mixing.mix_documents(known.select("__id", "source", "text"), SOURCE_WEIGHTS, SHARE, CAP, id_col="__id")
    taken = mixed.groupBy(F.col("id").alias("__taken"), F.col("source").alias("__source")).agg(F.min("copies").alias("__copies"))
    joined = known.join(taken, (F.col("__id") == F.col("__taken")) & F.col("source").eqNullSafe(F.col("__source"))).where("__copies > 0")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row: doc_id, size, text_crc32, shard, slot."""
    return sharding.shard_documents(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Neither the classifier nor the signature forest can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
