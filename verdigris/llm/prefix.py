"""Global running sums over a total order, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm import scratch


def global_prefix(df: DataFrame, order: list[Column], sums: dict[str, str], index: str, partitions: int | None = None) -> DataFrame:
    """Add to each row the sum of every earlier row.

    df: its columns should be few; they are range-partitioned by ``order`` and written once.
    order: a total order up to rows that are alike; range partitioning on all of it splits a hot leading key.
    sums: name of the new exclusive running sum -> column of non-null longs to sum.
    index: name of the new global row number, from 0.
    Returns df's columns, these, and nothing else. An empty df gives an empty result. Names that begin with ``__`` are
    reserved.

    The rows are range-partitioned; each partition's totals, one row a partition, are prefix-summed; each partition then
    adds its offset to its own running sums. The totals are the only rows that meet in one task.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumns({f"__k{i}": c for i, c in enumerate(order)})
    keys = [f"__k{i}" for i in range(len(order))]
    dealt = scratch.materialize(keyed.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums.values())])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = totals.select("__part", zero("__n").alias("__on"), *[zero(f"__t{i}").alias(f"__o{i}") for i in range(len(sums))])
    own = Window.partitionBy("__part").orderBy(*keys)
    above = own.rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns(
        {"__rn": F.row_number().over(own) - 1} | {f"__s{i}": F.coalesce(F.sum(c).over(above), F.lit(0)) for i, c in enumerate(sums.values())}
    )
    joined = local.join(F.broadcast(offsets), "__part")  # one row a partition: at most n
    return joined.select(
        *df.columns,
        *[(F.col(f"__s{i}") + F.col(f"__o{i}")).alias(name) for i, name in enumerate(sums)],
        (F.col("__rn") + F.col("__on")).cast("long").alias(index),
    )
