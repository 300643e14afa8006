"""Tables of one call and of others at the same time."""

import threading

from verdigris.llm import near_dup, scratch


def test_settle_leaves_other_threads_tables(spark):
    docs = spark.createDataFrame([(i, f"one two three four five six seven {i // 3}") for i in range(60)], "doc_id long, text string")
    others, errors, done = [], [], threading.Event()

    def write():
        try:
            while not done.is_set():
                others.append(scratch.materialize(spark.range(3), "other"))
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    thread = threading.Thread(target=write)
    thread.start()
    before = len(scratch._written.get(spark.sparkContext.applicationId, []))
    found = near_dup.near_duplicates(docs)
    done.set()
    thread.join()
    assert not errors and len(others) > 1
    assert found.count() == 60 and all(df.count() == 3 for df in others)
    assert len(scratch._written[spark.sparkContext.applicationId]) <= before + len(others) + 1  # its own are gone


def test_settle_after_a_failed_call(spark):
    scratch.mark(spark)  # a call that didn't settle
    kept = scratch.materialize(spark.range(2), "kept")
    since = scratch.mark(spark)
    scratch.materialize(spark.range(5), "step")
    out = scratch.settle(spark.range(4), "out", since)
    assert out.count() == 4 and kept.count() == 2 and len(since) == 2
