"""The work queue as a stream: batches in disorder, late and repeated events, tasks handed over by timers, tasks forgotten."""

import datetime
import random

from pyspark.sql import functions as F

from verdigris.streaming import jobs

START = datetime.datetime(2024, 1, 1)
LOG = "task long, ts timestamp, seq long, event string, consumer int"


def run(spark, folder, batches, **options):
    """Each batch a file and a micro-batch; the routes and the number of tasks in state after each."""
    rows = lambda b: [(t, None if s is None else START + datetime.timedelta(seconds=s), n, e, c) for t, s, n, e, c in b]
    for b in batches:
        spark.createDataFrame(rows(b), LOG).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    writer = jobs.work_queue(stream, **options).writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True)
    query = writer.start(f"{folder}/out")
    query.awaitTermination()
    out = spark.read.parquet(f"{folder}/out").withColumn("s", (F.unix_micros(F.col("at").cast("timestamp")) / 1e6 - START.replace(tzinfo=datetime.UTC).timestamp()).cast("double"))
    got = sorted(((r["task"], round(r["s"], 3), r["route"], r["failures"], r["handovers"], r["consumer"]) for r in out.collect()), key=str)
    return got, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def brute(events, end, idle, consumers, most):
    """Second by second: what is due goes after the events of its second have been heard, unless one of them is the task's."""
    out = []
    for task in {e[0] for e in events}:
        mine = sorted({e for e in events if e[0] == task}, key=lambda e: (e[1], e[2]))
        failures, open_at, holder, handovers = 0, None, 0, 0
        for second in range(end + 1):
            heard = [e for e in mine if e[1] == second]
            for _, _, _, event, consumer in heard:
                open_at = second if event == "fetch" else None
                if event == "fetch":
                    holder, handovers = consumer, 0
                failures = 0 if event == "ack" else failures + (event == "nack")
                if event == "nack":
                    out.append((task, second, "retry" if failures < most else "dead", failures, 0, None))
            if not heard and open_at is not None and second - open_at == idle:
                handovers += 1
                open_at = second if handovers < most else None
                holder = (holder + 1) % consumers if handovers < most else holder
                out.append((task, second, "claim" if handovers < most else "dead", failures, handovers, holder))
    return sorted(((t, round(float(s), 3), *r) for t, s, *r in out), key=str)


def test_random_log_in_disorder(spark, tmp_path):
    rng = random.Random(4)
    events = [(rng.randrange(6), rng.randrange(600), i, rng.choice(["enqueue", "fetch", "fetch", "ack", "nack", "nack"]), rng.randrange(3)) for i in range(150)]
    events.append((99, 720, 1000, "ack", 0))  # moves the watermark on
    arrival = sorted(events, key=lambda e: e[1] + rng.random() * 100)
    batches = [arrival[i : i + 30] + rng.sample(arrival[i : i + 30], 5) for i in range(0, 150, 30)] + [arrival[150:]]  # some sent again
    got, _ = run(spark, str(tmp_path), batches, late="120 seconds", idle_seconds=20, consumers=3)
    assert got == brute(events, 600, 20, 3, 3) and {r[2] for r in got} == {"retry", "dead", "claim"}


def test_claims_late_and_forgotten(spark, tmp_path):
    hour = 3600
    batches = [
        [(1, 0, 0, "fetch", 0), (2, 0, 1, "fetch", 1), (2, 30, 2, "ack", 1), (3, 5, 3, "nack", 0), (None, 1, 4, "fetch", 1), (4, None, 5, "nack", 0), (5, 2, None, None, None)],
        [(8, hour, 6, "ack", 0)],
        [(8, hour + 1, 12, "ack", 0)],
        [(2, 10, 7, "nack", 0), (3, 5, 3, "nack", 0), (9, 2 * hour, 8, "ack", 0)],  # late, and sent again
        [(3, 2 * hour + 100, 9, "nack", 0), (9, 3 * hour, 10, "ack", 0)],
        [(9, 80 * 24 * hour, 11, "ack", 0)],
    ]
    got, held = run(spark, str(tmp_path), batches, late="100 seconds", idle_seconds=60)
    handed = [(60.0, "claim", 0, 1, 1), (120.0, "claim", 0, 2, 0), (180.0, "dead", 0, 3, 0)]
    assert sorted(r[1:] for r in got if r[0] == 1) == handed and [r for r in got if r[0] in (2, 4, 5, 8, 9)] == []
    assert sorted((r[1], r[2], r[5]) for r in got if r[0] is None) == [(61.0, "claim", 0), (121.0, "claim", 1), (181.0, "dead", 1)]
    assert sorted(r[1:4] for r in got if r[0] == 3) == [(5.0, "retry", 1), (2 * hour + 100.0, "retry", 2)]
    assert held[-1] <= 1 and max(held) <= 6  # all but the newest event's task are forgotten


def test_tasks_share_buckets(spark, tmp_path):
    """Many tasks in a few rows of the state, one without a name and one named 0 among them: each is folded by itself."""
    rng = random.Random(5)
    names = [None, 0, *(10**17 + i for i in range(40))]
    events = [(rng.choice(names), rng.randrange(300), i, rng.choice(["fetch", "fetch", "ack", "nack"]), rng.randrange(3)) for i in range(200)]
    events.append((99, 420, 1000, "ack", 0))
    arrival = sorted(events, key=lambda e: e[1])
    got, held = run(spark, str(tmp_path), [arrival[:70], arrival[70:150], arrival[150:]], late="20 seconds", idle_seconds=20, consumers=3, buckets=4)
    assert got == brute(events, 400, 20, 3, 3) and len({r[0] for r in got}) > 35 and max(held) <= 4


def test_no_events(spark, tmp_path):
    assert run(spark, str(tmp_path), [[(1, None, 0, "nack", 0)]])[0] == []
