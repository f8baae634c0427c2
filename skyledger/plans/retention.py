"""Retention: folders of days that are too old are dropped."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from skyledger.plans.ingest import FLIGHTS, POSITIONS, REJECTED, STAGED, STATES
from skyledger.sources.stores import day_folders, folders, remove, remove_older

KEEP_DAYS = 365
# Below the warehouse: tables with a folder per date, and the column of that date.
DATED = {
    "fact_flights": "flight_date",
    "fact_positions": "position_date",
    "mart_carrier_daily": "flight_date",
}
# Tables that runs only add to, by the root they lie below; they have no date of their own.
ADDED_TO = {
    "silver": ("load_log",),
    "bronze": (REJECTED,),
    "root": ("raw_fr24_positions", "rejected_payloads", "pipeline_run_log"),
}
# A ledger tells which months were loaded and is small, so it outlives what it tells of.
KEEP_LEDGERS = 3 * KEEP_DAYS
LEDGERS = ("load_log", "pipeline_run_log")


def drop_expired(
    spark: SparkSession,
    run_date: dt.date,
    silver: str | None = None,
    bronze: str | None = None,
    root: str | None = None,
    keep_days: int = KEEP_DAYS,
) -> list[str]:
    """Drop what lies more than `keep_days` before the run, and return the folders.

    Silver flights and staged months below `silver`, landed feeds below `bronze`, facts and daily marts
    below the warehouse `root`.  A month is dropped when all its days are too old; rows without a day
    are kept.  Monthly marts stay: they are the history that is left.  Staged position batches, rejects and
    run logs, which are only added to, lose the files that were written so long ago, the logs after
    `KEEP_LEDGERS` (or `keep_days`, if that is longer).  Folders and files are found by listing, no rows
    are read.
    """
    first_kept = run_date - dt.timedelta(keep_days)
    dropped: list[str] = []

    def drop(dated: dict[dt.date, str]) -> None:
        for day, folder in sorted(dated.items()):
            if day < first_kept and remove(spark, folder):
                dropped.append(folder)

    if silver:
        drop(day_folders(spark, f"{silver}/{FLIGHTS}", "flight_date"))
        # A month counts by its last day.
        drop(_months(spark, f"{silver}/{STAGED}"))
    if bronze:
        for feed in (POSITIONS, STATES):
            for month, folder in _months(spark, f"{bronze}/{feed}").items():
                days = {month.replace(day=int(_value(name))): f"{folder}/{name}" for name in folders(spark, folder)}
                drop({month: folder} if month < first_kept else days)
    if root:
        for table, column in DATED.items():
            drop(day_folders(spark, f"{root}/{table}", column))
    for place, parent in (("silver", silver), ("bronze", bronze), ("root", root)):
        for table in ADDED_TO[place] if parent else ():
            days = max(KEEP_LEDGERS, keep_days) if table in LEDGERS else keep_days
            oldest = dt.datetime.combine(run_date - dt.timedelta(days), dt.time())
            dropped += remove_older(spark, f"{parent}/{table}", oldest)
    return dropped


def _months(spark: SparkSession, path: str) -> dict[dt.date, str]:
    """Folders `year=/month=` by the last day of the month."""
    found = {}
    for year in folders(spark, path):
        for month in folders(spark, f"{path}/{year}"):
            y, m = int(_value(year)), int(_value(month))
            found[dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(1)] = f"{path}/{year}/{month}"
    return found


def _value(folder: str) -> str:
    return folder.partition("=")[2]
