"""The folder that driver and executors share, for indexes, streaming sinks and checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_local: list[str] = []
_made: dict[tuple, object] = {}


def once(spark: SparkSession, key: tuple, make: Callable[[], T]) -> T:
    """What ``make`` gives, made anew for each Spark application only; the tables that it wrote must still be there."""
    whole = (spark.sparkContext.applicationId, *key)
    if whole not in _made:
        _made[whole] = make()
    return _made[whole]  # type: ignore[return-value]


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset and Spark runs in this one process (tests), below a
    folder of this machine. On a cluster an unset folder is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="verdigris-"))
        root = f"file://{_local[0]}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to a new folder and read back, so that what is used twice is computed once."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
