"""What several operators share: folders, intermediate tables, Arrow columns, connected components."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import work_folder


# Classes of characters.
OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, points):
            table[ord(run[0][0]) : ord(run[0][-1]) + 1] = kind
    return table


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def staged(rows: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from there.

    For results that are read more than once, and to cut lineage: a lost executor costs no more than
    reading again.  With `large`, rows of megabytes each, every row is a row group of its own: writers
    gather and readers decode a row group at a time.
    """
    path = work_folder(rows.sparkSession, name)
    writer = rows.write.option("parquet.block.row.count.limit", 1) if large else rows.write
    writer.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def row_by_row(spark: SparkSession) -> Iterator[None]:
    """Plans that run in here pass rows to Python one at a time, not all of a partition in one batch of Arrow."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 1)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpointed(rows: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; its files go when the result is dropped."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(rows.sparkSession, "checkpoints"))
    return rows.checkpoint()


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8 bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """`node`, `component`: the smallest node that links reach, for every node of an edge.

    Each round lets every node take the smallest label among its own and its neighbours', then jumps
    to the label of that label; rounds grow with the logarithm of a component's width.  Nothing is
    gathered per node: minima combine before the shuffle, and joins are left to the skew handling of
    adaptive execution, so a node with very many links does no harm.  The loop holds a count only.
    """
    links = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other")
    links = checkpointed(links.union(links.select("other", "node")).distinct())
    labels = links.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("component"))
    while True:
        labels = checkpointed(labels)
        neighbours = links.join(labels.withColumnRenamed("node", "other"), "other").select("node", "component")
        nearest = neighbours.union(labels).groupBy("node").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        moved = (
            nearest.join(jump, "near")
            .join(labels, "node")
            .select("node", F.least("near", "far").alias("component"), F.col("component").alias("before"))
        )
        moved = checkpointed(moved)
        if moved.filter("component <> before").isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")


def vocabulary_file(path: str) -> str:
    """The path of a vocabulary file that must be there on every machine."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return path
