"""Small files of appended days are packed into files of a good size."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from skyledger.operators.loading import on_days
from skyledger.sources.stores import file_sizes
from skyledger.sources.tables import read_table
from skyledger.sources.writers import staged, write_by_date

TARGET = 128 << 20  # bytes of a file
# A file below this share of the target is small; so many of them in a day are packed.
SMALL = 0.5
LEAST_FILES = 2
DAYS_AT_ONCE = 500


def packable(spark: SparkSession, path: str, day: str, target: int = TARGET) -> dict[dt.date | None, list[int]]:
    """Days with several small files, and the sizes of all their files; folders are listed, no rows read."""
    sizes = file_sizes(spark, path, day)
    return {d: found for d, found in sizes.items() if sum(size < SMALL * target for size in found) >= LEAST_FILES}


def compact(
    spark: SparkSession, path: str, schema: T.StructType, day: str, cluster_by: Sequence[str] = (), target: int = TARGET
) -> list[dt.date | None]:
    """Rewrite the days that hold several small files, as files of about `target` bytes; return the days.

    Each day's folder is replaced as a whole, and days without small files are not touched.  Rows per
    file follow from the bytes that a row of these days takes now.  No load may run meanwhile.
    """
    chosen = packable(spark, path, day, target)
    days = sorted(chosen, key=lambda d: (d is None, d))
    for first in range(0, len(days), DAYS_AT_ONCE):
        part = days[first : first + DAYS_AT_ONCE]
        # Files that are being read can not be overwritten.
        rows = staged(on_days(read_table(spark, path, schema), part, day), "compacted")
        size = sum(sum(chosen[d]) for d in part)
        per_file = max(1, math.ceil(rows.count() * target / max(size, 1)))
        write_by_date(rows, path, day, cluster_by, spread=True, rows_per_file=per_file, interleave=len(cluster_by) > 1)
    return days
