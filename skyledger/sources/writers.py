"""Parquet and NDJSON writers."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.order import interleaved
from skyledger.functions.times import utc_date
from skyledger.operators.loading import counts_of, day_passes, on_days
from skyledger.session import work_folder
from skyledger.sources.stores import NO_VALUE, missing, remove, remove_days, remove_empty

# Keeps the files of a large date at a size that several tasks can read.
ROWS_PER_FILE = 5_000_000
# Rows of a day that one task takes at least, before a day is cut.
ROWS_PER_TASK = 1_000_000
# Folders that one task opens where days are many and small.
DAYS_PER_TASK = 32
# Spark's setting by which the shuffle files of a finished query go at once.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Of tables that are read once or twice and then removed.
STAGED_CODEC = "zstd"


@dataclass(frozen=True)
class Written:
    """What a write did; the figures were counted while writing."""

    path: str | None
    rows: int
    measures: Mapping[str, Any] = field(default_factory=dict)


def write_by_date(
    rows: DataFrame,
    path: str,
    day: str,
    cluster_by: Sequence[str] = (),
    mode: str = "replace_dates",
    measures: Mapping[str, Column] | None = None,
    gathered: bool = False,
    rebuilt: Iterable[dt.date | None] = (),
    spread: bool = False,
    tasks: int | None = None,
    rows_per_file: int = ROWS_PER_FILE,
    interleave: bool = False,
) -> Written:
    """Write one folder per date, rows sorted by `cluster_by` for row-group skipping.

    With `interleave` its columns take turns bit by bit, so that a filter on any of them skips row groups.

    `mode`: "replace_dates" rewrites only the dates that occur in `rows`, "replace_all" the table,
    "append" adds files.  With "replace_dates", `rebuilt` names the dates that `rows` were made for:
    those without rows lose the folder that an earlier run wrote.

    The rebalance hint gives each date to one task as long as it is small and lets adaptive
    execution cut a date that is not.  With `gathered` there is no shuffle: the rows come unshuffled
    from a table with a folder per date, so a task holds few dates; of a large file that several tasks
    read, each writes a file of its own.  With `spread` the rows are a written table, whose days are
    counted first: a small batch over very many days is written by as many tasks as its files need,
    where the hint would leave one, see `_spread`.  Very many rows are then shuffled and written in
    passes of whole days, see `day_passes`: on disk is the shuffle of one pass, and of the folders
    that are replaced there are twice no more than its days.  A caller who knows the number of days,
    none of which is large, names the `tasks` that they are dealt over.

    The count sits in the stage that writes: there a task's figures are taken once, also when
    executors are lost and tasks run again.
    """
    days = list(rebuilt)
    put = dict(path=path, day=day, cluster_by=cluster_by, mode=mode, measures=measures, listed=bool(days),
               rows_per_file=rows_per_file, interleave=interleave)
    if spread and not gathered:
        counts = counts_of(rows, day)
        # Other figures than the count can not be added up, and a table is replaced by one write.
        passes = [list(counts)] if measures or mode == "replace_all" else day_passes(counts)
        per_task = max(rows_per_file, ROWS_PER_TASK)
        seen = []
        for part in passes or [[]]:
            few = on_days(rows, part, day) if len(passes) > 1 else rows
            seen.append(_write_days(_spread(few, day, {d: counts[d] for d in part}, per_task), **put))
    elif gathered:
        seen = [_write_days(rows, **put)]
    else:
        seen = [_write_days(rows.repartition(tasks, day) if tasks else rows.hint("rebalance", day), **put)]
    if days:
        full = {d for figures in seen for d in figures["_days"] or ()}
        remove_days(rows.sparkSession, path, day, [d for d in days if (NO_VALUE if d is None else d.isoformat()) not in full])
    return _report(path, {**seen[-1], "rows": sum(figures["rows"] for figures in seen)})


def _write_days(
    placed: DataFrame,
    path: str,
    day: str,
    cluster_by: Sequence[str],
    mode: str,
    measures: Mapping[str, Column] | None,
    listed: bool,
    rows_per_file: int,
    interleave: bool,
) -> dict[str, Any]:
    """One write of rows that lie where their files are made; what was counted, with the days if they are `listed`."""
    written = {"_days": F.collect_set(F.coalesce(F.col(day).cast("string"), F.lit(NO_VALUE)))} if listed else {}
    counted, seen = _counted(placed, {**(measures or {}), **written})
    if interleave:
        # A column, as a sort computes an expression again for each comparison.
        ordered = counted.withColumn("_order", interleaved(*cluster_by)).sortWithinPartitions(day, "_order").drop("_order")
    else:
        ordered = counted.sortWithinPartitions(day, *cluster_by)
    save = "append" if mode == "append" else "overwrite"
    overwrite = "static" if mode == "replace_all" else "dynamic"
    with shuffles_dropped(placed.sparkSession):
        (
            ordered.write.mode(save)
            .option("partitionOverwriteMode", overwrite)
            .option("maxRecordsPerFile", rows_per_file)
            .partitionBy(day)
            .parquet(path)
        )
    return dict(seen.get)


def _spread(rows: DataFrame, day: str, counts: Mapping[dt.date | None, int], per_task: int) -> DataFrame:
    """Rows dealt by day over tasks by the number of days and rows; a large day gets several tasks."""
    tasks = max(1, math.ceil(len(counts) / DAYS_PER_TASK), math.ceil(sum(counts.values()) / per_task))
    parts = F.lit(1)
    for value, n in counts.items():
        if n > per_task:
            parts = F.when(F.col(day).eqNullSafe(F.lit(value)), math.ceil(n / per_task)).otherwise(parts)
    return rows.repartition(tasks, day, F.pmod(F.monotonically_increasing_id(), parts))


def append_table(rows: DataFrame, path: str, measures: Mapping[str, Column] | None = None) -> Written:
    """Append to an unpartitioned staging table."""
    counted, seen = _counted(rows, measures)
    with shuffles_dropped(rows.sparkSession):
        counted.write.mode("append").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    return _report(path, seen.get)


def replace_table(
    rows: DataFrame, path: str, measures: Mapping[str, Column] | None = None, codec: str | None = None
) -> Written:
    """Rewrite an unpartitioned table; a repeated run leaves the same state.

    `codec`: another compression than the session's.
    """
    counted, seen = _counted(rows, measures)
    writer = counted.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE)
    with shuffles_dropped(rows.sparkSession):
        (writer.option("compression", codec) if codec else writer).parquet(path)
    return _report(path, seen.get)


def staged(rows: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from there.

    For results that are read more than once: they are computed once, and a lost executor costs no
    more than reading again.
    """
    path = work_folder(rows.sparkSession, name)
    return _stage(rows, path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A `staged` whose tables are removed at the end of the block: nothing may read them after it."""
    made: list[str] = []

    def stage(rows: DataFrame, name: str) -> DataFrame:
        made.append(work_folder(spark, name))
        return _stage(rows, made[-1])

    try:
        yield stage
    finally:
        for path in made:
            remove(spark, path)


def _stage(rows: DataFrame, path: str) -> DataFrame:
    replace_table(rows, path, codec=STAGED_CODEC)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes in this block go when a write ends.

    They would stay until the driver collects its garbage, which has little of it while the disks of the
    executors fill up.
    """
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def land_lines(lines: DataFrame, path: str) -> Written:
    """Write NDJSON text below year=/month=/day= folders of the UTC poll date; nothing if there is none."""
    made = missing(lines.sparkSession, path)
    at = utc_date(F.col("polled_at"))
    dated = lines.select(
        "value",
        F.date_format(at, "yyyy").alias("year"),
        F.date_format(at, "MM").alias("month"),
        F.date_format(at, "dd").alias("day"),
    )
    counted, seen = _counted(dated.hint("rebalance", "year", "month", "day"), None)
    counted.write.mode("append").partitionBy("year", "month", "day").text(path)
    landed = _report(path, seen.get)
    if landed.rows:
        return landed
    remove_empty(lines.sparkSession, made)
    return Written(None, 0)


def write_flight_files(flights: DataFrame, path: str) -> None:
    """Flights as CSV text with a header, the format of the monthly source."""
    flights.select(*[F.col(c).cast("string") for c in flights.columns]).write.mode("overwrite").option(
        "header", True
    ).csv(path)


def append_lines(lines: DataFrame, header: str, path: str) -> None:
    """Add files of text lines to a folder of CSV files, one per partition, each with the header first."""
    # Row numbers start anew in each partition, in the lower 33 bits.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    headed = F.when(first, F.concat(F.lit(f"{header}\n"), F.coalesce("value", F.lit("")))).otherwise(F.col("value"))
    # A partition must stay one file, or the reader takes a line for the header of the next.
    lines.select(headed.alias("value")).write.mode("append").option("maxRecordsPerFile", 0).text(path)


def _counted(rows: DataFrame, measures: Mapping[str, Column] | None) -> tuple[DataFrame, Observation]:
    seen = Observation()
    extra = [column.alias(name) for name, column in (measures or {}).items()]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *extra), seen


def _report(path: str, seen: Mapping[str, Any]) -> Written:
    figures = dict(seen)
    figures.pop("_days", None)
    return Written(path, figures.pop("rows"), figures)
