"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and Spark runs in this one process (tests,
notebooks) a local one is made; on a cluster that is an error.
A written table cuts lineage and survives lost executors. ``settle`` removes what led to a result, ``clear`` all that this
session wrote.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}
_tables: dict[str, str] = {}  # names of bucketed tables by path


class _Noting(threading.local):
    """The open notes of this thread, the innermost last."""

    def __init__(self) -> None:
        self.lists: list[list[str]] = []

    def append(self, noted: list[str]) -> None:
        self.lists.append(noted)

    def pop(self) -> list[str]:
        return self.lists.pop()

    def __bool__(self) -> bool:
        return bool(self.lists)


_noting = _Noting()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, set here only where nobody has set one."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty() and context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if current.isEmpty():
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="verdigris-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    for noted in _noting.lists:
        noted.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write ``df`` in buckets by ``key``, one row a key, and return it read back: joins on that column don't shuffle it again.
    There are as many buckets as shuffle partitions."""
    spark = df.sparkSession
    path, n = new_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    _tables[path] = f"{name}_{uuid.uuid4().hex}"
    unique = df.repartition(n, key).dropDuplicates([key])
    unique.write.bucketBy(n, key).option("path", path).saveAsTable(_tables[path])
    return spark.table(_tables[path])


def mark(spark: SparkSession) -> list[str]:
    """From now on the tables that this thread writes are noted, for ``settle``; other threads' tables aren't."""
    noted: list[str] = []
    _noting.append(noted)
    return noted


def settle(df: DataFrame, name: str, since: list[str]) -> DataFrame:
    """Materialize a result and delete the tables that this thread has written for it after ``mark`` gave ``since``."""
    spark = df.sparkSession
    out = materialize(df, name)
    while _noting and _noting.pop() is not since:  # with it those of calls inside it that failed
        pass
    paths = since[:-1]
    _delete(spark, paths)
    written = _written[spark.sparkContext.applicationId]
    for path in paths:
        written.remove(path)
    return out


def clear(spark: SparkSession) -> int:
    """Delete every table that this session has written; their DataFrames can't be read afterwards."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if path in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
