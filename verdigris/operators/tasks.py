"""The state of work-queue tasks as a fold over their log of events, which only ever grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def states(log: DataFrame, now: Column, max_attempts: int = 3, idle_seconds: int = 60) -> DataFrame:
    """log: (task, at timestamp, event), events enqueue, fetch, ack, nack. One row a task: attempts, last event, state
    (pending, processing, done, dead) and stalled (processing and idle for ``idle_seconds`` or more at ``now``).

    A nack sends a task back to the queue until ``max_attempts`` have failed, and then to the dead letters. The fold is an
    aggregate, so that a task's events are combined before the shuffle.
    """
    last = F.max_by("event", F.struct("at", F.col("event")))
    folded = log.groupBy("task").agg(F.count_if(F.col("event") == "nack").alias("failures"), last.alias("last_event"), F.max("at").alias("last_at"), F.count_if(F.col("event") == "ack").alias("acks"))
    state = (
        F.when(F.col("acks") > 0, "done").when(F.col("failures") >= max_attempts, "dead").when(F.col("last_event") == "fetch", "processing").otherwise("pending")
    )
    out = folded.withColumn("state", state)
    idle = now.cast("timestamp").cast("long") - F.col("last_at").cast("timestamp").cast("long")
    return out.select("task", (F.col("failures") + 1).alias("attempt"), "last_event", "state", ((F.col("state") == "processing") & (idle >= idle_seconds)).alias("stalled"))


def progress(tasks: DataFrame, batch: Column) -> DataFrame:
    """Per batch: total, done, dead, and whether every task is done. Dead letters leave a batch unfinished."""
    return tasks.groupBy(batch.alias("batch")).agg(
        F.count("*").alias("total"), F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "dead").alias("dead"), (F.count_if(F.col("state") == "done") >= F.count("*")).alias("complete")
    )
