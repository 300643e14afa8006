"""Balanced contiguous shards from global prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm import scratch
from verdigris.llm.prefix import global_prefix


def shard_by_bytes(rows: DataFrame, shards: int, size_col: str, order: list[Column]) -> DataFrame:
    """Cut the rows, in ``order``, into ``shards`` contiguous runs of near-equal total size.

    A row belongs to the shard in whose equal share of the total its first byte falls, so a shard's total is off its
    target by less than one row at either end. A row larger than a target can leave the next shards empty.

    rows: few columns (they are shuffled and written twice); ``size_col`` a long, null or negative counting as 0.
    order: rows alike in all of it may change places, else reruns agree.
    Returns rows' columns, ``shard`` int from 0, ``slot`` long (gapless from 0 within a shard, in order). Where the total
    is 0, all rows are in shard 0. An empty table gives an empty result. Columns named ``shard`` or ``slot`` are replaced.
    """
    rows = rows.drop("shard", "slot")
    sized = rows.withColumn("__size", F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)))
    placed = scratch.materialize(global_prefix(sized, order, {"__before": "__size"}, "__row"), "placed")
    total = placed.agg(F.sum("__size")).first()[0] or 0
    share = F.expr(f"cast((cast(__before as decimal(38, 0)) * {shards}) div {max(total, 1)} as int)")
    dealt = placed.withColumn("shard", F.least(share, F.lit(shards - 1)))
    firsts = dealt.groupBy("shard").agg(F.min("__row").alias("__first"))  # a row a shard
    return dealt.join(F.broadcast(firsts) if shards <= 100_000 else firsts, "shard").select(*rows.columns, "shard", (F.col("__row") - F.col("__first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Shard documents by the UTF-8 bytes of their text plus ``overhead`` (a null text: the overhead alone).

    The order is by a hash of the text, then id: it mixes sources and keeps equal texts side by side, so that only a group
    that a cut falls into is parted, however large it is. The text itself isn't moved. Returns id, size long, text_crc32
    long (null for a null text), shard, slot. Null ids come first among equal texts; repeated rows each have a slot.
    """
    text = F.col(text_col).cast("string")
    sized = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("__hash"),
    )
    order = [F.col("__hash"), F.col(id_col), F.col("text_crc32")]
    return shard_by_bytes(sized, shards, "size", order).drop("__hash")
