"""Silver flights to the Gold tables."""

from __future__ import annotations

import datetime as dt
import logging
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.flights import fact_flights
from skyledger.operators.loading import days_of, on_days
from skyledger.operators.marts import route_performance
from skyledger.schemas import SILVER_FLIGHTS
from skyledger.sources.stores import folders
from skyledger.sources.tables import lies_by_day, read_table
from skyledger.sources.writers import write_by_date

log = logging.getLogger(__name__)

FLIGHT_CLUSTER = ["carrier_code", "origin_airport"]
MART_DAYS_PER_TASK = 8
ROUTE_CLUSTER = ["origin_airport", "dest_airport"]


def build_fact_flights(
    spark: SparkSession, run_date: str, silver: str, gold: str, only_run_date: bool = False
) -> int:
    """Write `<gold>/fact_flights` from `<silver>/bts` and return the rows written.

    By default every date is rebuilt; `only_run_date` rebuilds the one date `run_date` (YYYYMMDD).
    If silver has a folder per date, nothing is shuffled.
    """
    rebuilt = [parse_day(run_date)] if only_run_date else []
    flights = _silver(spark, silver, rebuilt)
    if only_run_date:
        flights = flights.filter(F.col("flight_date") == rebuilt[0])
    mode = "replace_dates" if only_run_date else "replace_all"
    done = write_by_date(
        fact_flights(flights),
        f"{gold}/fact_flights",
        "flight_date",
        FLIGHT_CLUSTER,
        mode,
        gathered=lies_by_day(spark, f"{silver}/bts", "flight_date"),
        rebuilt=rebuilt,
        interleave=True,
    )
    log.info("fact_flights: %s rows", f"{done.rows:,}")
    return done.rows


def build_route_aggregates(
    spark: SparkSession, silver: str, gold: str, touched: DataFrame | None = None
) -> int:
    """Write `<gold>/mart_route_performance` from `<silver>/bts` and return the rows written.

    `touched` (one column `flight_date`) restricts the refresh to days that changed; a day that has no
    flights for the mart any more loses its rows.
    """
    days = [] if touched is None else days_of(touched, "flight_date")
    flights = _silver(spark, silver, days)
    if touched is not None:
        flights = on_days(flights, days, "flight_date")
    mode = "replace_all" if touched is None else "replace_dates"
    mart = route_performance(flights, "day")
    path = f"{gold}/mart_route_performance"
    # A day of the mart is bounded by its routes and carriers; a rebuild of all days deals them over tasks.
    tasks = None if days else math.ceil(len(folders(spark, f"{silver}/bts")) / MART_DAYS_PER_TASK)
    done = write_by_date(mart, path, "flight_date", ROUTE_CLUSTER, mode, rebuilt=days, tasks=tasks, interleave=True)
    log.info("mart_route_performance: %s rows", f"{done.rows:,}")
    return done.rows


def _silver(spark: SparkSession, silver: str, days: list[dt.date | None]) -> DataFrame:
    """Silver flights; for a single day no other folder is listed."""
    path = f"{silver}/bts"
    only = f"flight_date={days[0]}" if len(days) == 1 and days[0] is not None else ""
    if only and only in folders(spark, path):
        return read_table(spark, path, SILVER_FLIGHTS, only)
    return read_table(spark, path, SILVER_FLIGHTS)


def silver_to_gold(
    spark: SparkSession, run_date: str, silver: str, gold: str, only_run_date: bool = False
) -> dict[str, int]:
    touched = None
    if only_run_date:
        touched = spark.createDataFrame([(parse_day(run_date),)], "flight_date DATE")
    return {
        "fact_flights": build_fact_flights(spark, run_date, silver, gold, only_run_date),
        "mart_route_performance": build_route_aggregates(spark, silver, gold, touched),
    }


def parse_day(text: str) -> dt.date:
    return dt.datetime.strptime(text, "%Y%m%d").date()
