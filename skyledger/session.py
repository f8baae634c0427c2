"""Session settings and the shared work folder."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan at run time: merge small shuffle partitions, split skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "snappy",
    # Overwriting a date must leave all other dates in place.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
    # Quantiles are aggregated as objects; beyond this many groups a task sorts instead, which is
    # slower.  A group's sketch holds no more than its rows in the task, so memory stays in proportion
    # to the task's input.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000",
}


# A shuffle partition of this size sorts and aggregates within an executor core's memory.
BYTES_PER_PARTITION = 128 << 20


def shuffle_partitions(expected_bytes: int) -> int:
    """Partitions that a shuffle of so many bytes starts with; adaptive execution merges small ones."""
    return max(200, math.ceil(expected_bytes / BYTES_PER_PARTITION))


def build_session(
    app_name: str = "skyledger",
    master: str | None = None,
    expected_bytes: int | None = None,
    **extra: str,
) -> SparkSession:
    """Start or reuse a session.  Cluster resources stay with spark-submit and its defaults.

    `expected_bytes`, the size of the largest shuffle, sets its degree: the default of 200 partitions
    would be far too few for terabytes.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS)
    if expected_bytes is not None:
        partitions = str(shuffle_partitions(expected_bytes))
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = partitions
    for key, value in {**settings, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder that the cluster names in `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder of the machine.
    """
    return f"{_work_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear_work(spark: SparkSession) -> None:
    """Remove all work folders of this application; their tables can not be read any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(_work_root(spark))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _work_root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        # An application on one machine; "local-cluster" has executors of its own.
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/skyledger/{spark.sparkContext.applicationId}"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="skyledger-")
