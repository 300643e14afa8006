"""Structured Streaming twins of the trend, idempotency, session and work-queue operators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources.shared import new_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events file of a folder as a stream; on a cluster a folder that files keep arriving in."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Process all that is there into Parquet files, exactly once through the checkpoint, and read them."""
    spark, out = stream.sparkSession, new_folder(stream.sparkSession, name)
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """The same for aggregates that are rewritten whole after each batch."""
    spark, out = stream.sparkSession, new_folder(stream.sparkSession, name)
    query = (
        stream.writeStream.outputMode("complete").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def trend(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Number and mean value by type in tumbling windows."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def once_per_key(events: DataFrame, key: str, late: str = "60 days") -> DataFrame:
    """Each key once, however often it is sent within ``late`` of event time; a batch that is retried adds nothing. Keys that
    are older than the watermark are forgotten, so that the state is bounded by what ``late`` covers."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]).select(key)


_ROUTES = "task long, micros long, route string, failures long, handovers int, consumer int"
_HELD = (
    "task array<long>, failures array<long>, handovers array<int>, holder array<int>, since array<long>, last array<long>, "
    "of array<int>, at array<long>, seq array<long>, event array<string>, consumer array<int>"
)
_NEVER = -1


@dataclass
class _Task:
    """One task of a work queue: events that wait for the watermark, and what the events before it made of the task."""

    waiting: set[tuple[int, int, str, int]]
    failures: int = 0
    handovers: int = 0
    holder: int = 0
    since: int = _NEVER
    last: int = 0

    def routes(self, limit: int, idle: int, forget: int, consumers: int, most: int) -> Iterator[tuple]:
        """Fold all up to ``limit``, in microseconds, in order of time; a handover due at an event's very time isn't made."""
        ready = sorted(e for e in self.waiting if e[0] <= limit)
        self.waiting.difference_update(ready)
        for at, _, event, consumer in ready:
            yield from self._hand_over(at - 1, idle, consumers, most)
            if self.last + forget < at:
                self.failures = 0
            self.last, self.since = at, at if event == "fetch" else _NEVER
            if event == "fetch":
                self.holder, self.handovers = consumer, 0
            elif event == "ack":
                self.failures = 0
            elif event == "nack":
                self.failures += 1
                yield at, "retry" if self.failures < most else "dead", self.failures, 0, None
        yield from self._hand_over(limit, idle, consumers, most)
        if self.last + forget <= limit:
            self.failures = 0

    def _hand_over(self, limit: int, idle: int, consumers: int, most: int) -> Iterator[tuple]:
        while self.since != _NEVER and self.since + idle <= limit:
            self.since += idle
            self.handovers += 1
            lost, at = self.handovers >= most, self.since
            self.holder = self.holder if lost else (self.holder + 1) % consumers
            yield at, "dead" if lost else "claim", self.failures, self.handovers, self.holder
            self.since = _NEVER if lost else at

    def finished(self) -> bool:
        return not self.waiting and self.since == _NEVER and not self.failures

    def wakes(self, idle: int, forget: int) -> int:
        """When there is something to do without a new event, in microseconds."""
        times = [e[0] for e in self.waiting]
        if self.since != _NEVER:
            times.append(self.since + idle)
        return min(times, default=self.last + forget)


def _held(tasks: dict[int | None, _Task]) -> tuple:
    """A bucket's tasks as a row of lists; a waiting event has the place of its task."""
    kept = list(zip(*((n, t.failures, t.handovers, t.holder, t.since, t.last) for n, t in tasks.items()), strict=True))
    events = list(zip(*((i, *e) for i, t in enumerate(tasks.values()) for e in t.waiting), strict=True)) or [()] * 5
    return tuple(list(c) for c in (*kept, *events))


def _restored(held: tuple) -> dict[int | None, _Task]:
    names, *kept = held[:6]
    out = [_Task(set(), *k) for k in zip(*kept, strict=True)]
    for of, *event in zip(*held[6:], strict=True):
        out[of].waiting.add(tuple(event))
    return dict(zip(names, out, strict=True))


def work_queue(log: DataFrame, late: str = "1 hour", idle_seconds: int = 60, consumers: int = 2, max_attempts: int = 3, forget_days: int = 60, buckets: int = 4096) -> DataFrame:
    """What becomes of the tasks of a work queue, as its log of events arrives: (task, at, route, failures, handovers, consumer).

    log: (task long, ts timestamp, seq long, event, consumer int), events enqueue, fetch, ack, nack; seq tells events of one time
    apart, consumer is who fetched, from 0. A nack gives the route ``retry``, or ``dead`` from the ``max_attempts``-th since the
    last ack. A task that nothing has been heard of for ``idle_seconds`` since it was fetched goes to the next consumer by a
    timer (``claim``), again after as long, and is ``dead`` in place of its ``max_attempts``-th handover.

    Events wait until the watermark, ``late`` behind the newest, has passed them and are folded in order of (ts, seq), so that
    the routes don't depend on how events fall into batches. Later ones are left out, as are events without a time; an event
    that is sent again (the same in all columns) counts once. A null event or consumer counts as enqueue and 0.

    A task is forgotten with its ack, or ``forget_days`` after its last event, which also ends its count of failures, so that
    the state has each open task and never more events than ``late`` and one batch cover. Tasks are kept by ``buckets`` of a
    hash, as a call of Python for each task costs far more than folding its events; a bucket's tasks lie in one row of the state,
    which is written anew when one of them changes. The number stays as it is over a checkpoint's life. Bound a batch by the
    source's ``maxFilesPerTrigger``; with many open tasks set ``spark.sql.streaming.stateStore.providerClass`` to RocksDB's."""
    idle, forget = idle_seconds * 1_000_000, forget_days * 86_400_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tasks = _restored(state.get) if state.exists else {}
        for b in batches:
            names = [n if known else None for n, known in zip(b["task"].tolist(), b["named"].tolist(), strict=True)]
            for n, *e in zip(names, b["micros"].tolist(), b["seq"].tolist(), b["event"].tolist(), b["consumer"].tolist(), strict=True):
                tasks.setdefault(n, _Task(set())).waiting.add(tuple(e))
        watermark = state.getCurrentWatermarkMs()
        rows = [(n, *r) for n, t in tasks.items() for r in t.routes(watermark * 1000 + 999, idle, forget, consumers, max_attempts)]
        tasks = {n: t for n, t in tasks.items() if not t.finished()}
        if tasks:
            state.update(_held(tasks))
            state.setTimeoutTimestamp(max(min(t.wakes(idle, forget) for t in tasks.values()) // 1000 - 1, watermark + 1))
        elif state.exists:
            state.remove()
        types = {"task": "Int64", "micros": "int64", "route": "object", "failures": "int64", "handovers": "int32", "consumer": "Int32"}
        if rows:  # typed column by column: large numbers beside nulls would pass through doubles else
            yield pd.DataFrame({name: pd.array(column, dtype=kind) for (name, kind), column in zip(types.items(), zip(*rows, strict=True), strict=True)})

    # Watermarks and timers count in milliseconds: times are cut to these for them, the full ones order the events.
    known = log.where("ts IS NOT NULL").select(
        F.pmod(F.xxhash64("task"), F.lit(buckets)).cast("int").alias("bucket"), F.coalesce("task", F.lit(0)).cast("long").alias("task"), F.col("task").isNotNull().alias("named"),
        F.date_trunc("millisecond", "ts").alias("ts"), F.unix_micros("ts").alias("micros"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"),
        F.coalesce("event", F.lit("enqueue")).alias("event"), F.coalesce("consumer", F.lit(0)).cast("int").alias("consumer"),
    )
    routes = known.withWatermark("ts", late).groupBy("bucket").applyInPandasWithState(step, _ROUTES, _HELD, "append", "EventTimeTimeout")
    return routes.select("task", F.timestamp_micros("micros").cast("timestamp_ntz").alias("at"), "route", "failures", "handovers", "consumer")


def retries(log: DataFrame, late: str = "1 hour", max_attempts: int = 3) -> DataFrame:
    """For each nack of a log as ``work_queue`` takes it: task, failures so far, and whether the task is retried or dead."""
    nacks = log.where("event IN ('nack', 'ack')")
    return work_queue(nacks, late, max_attempts=max_attempts).select("task", "failures", "route")
