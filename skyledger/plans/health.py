"""The daily health run: figures of one day's facts, kept in a table, and what is wrong with them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.marts import daily_stats
from skyledger.operators.ranking import top_carriers
from skyledger.schemas import DAILY_HEALTH, STAR_FLIGHTS
from skyledger.sources.stores import day_folders
from skyledger.sources.tables import read_table, read_table_or_empty
from skyledger.sources.writers import replace_table

# Columns that the figures are made of; no others are read.
READ = ["flight_date", "carrier_code", "arr_delay_minutes", "is_cancelled"]
HEALTH = "daily_health"
# What a day must hold to, given the days before it: shares of the flights, and their number.
ALERTS = {
    "no_flights": "total_flights = 0",
    "few_flights": "total_flights < 0.5 * usual_flights",
    "many_cancelled": "cancelled_flights > 0.1 * total_flights",
    "many_severe": "severe_delay_count > 0.1 * total_flights",
}


def health(flights: DataFrame, days: DataFrame, carriers: int = 3) -> DataFrame:
    """One row per `flight_date` of `days`: `daily_stats` and the busiest carriers.

    `carriers` is an array of `carrier_code`, `total_flights`, the busiest first.  A day without flights
    has zeros, no average and an empty array.  Rows without a date belong to no day.
    """
    figures = daily_stats(flights.filter("flight_date IS NOT NULL"))
    ranked = top_carriers(flights.filter("flight_date IS NOT NULL"), carriers).groupBy("flight_date").agg(
        F.array_sort(F.collect_list(F.struct("position", "carrier_code", "total_flights"))).alias("ranked")
    )
    joined = days.select("flight_date").join(figures, "flight_date", "left").join(ranked, "flight_date", "left")
    return joined.select(
        "flight_date",
        *[_or_zero(c) for c in ("total_flights", "cancelled_flights", "severe_delay_count")],
        "avg_delay_minutes",
        F.coalesce(
            F.transform("ranked", lambda r: F.struct(r["carrier_code"].alias("carrier_code"), r["total_flights"].alias("total_flights"))),
            F.array().cast(DAILY_HEALTH["top_carriers"].dataType),
        ).alias("top_carriers"),
    )


def _or_zero(figure: str) -> Column:
    return F.coalesce(F.col(figure), F.lit(0)).cast("bigint").alias(figure)


def check_day(
    spark: SparkSession, root: str, day: dt.date, run_at: dt.datetime, alerts: Mapping[str, str] = ALERTS, usual: int = 28
) -> DataFrame:
    """Figure out the health of one day from the stored facts, keep it, and return its row.

    The row goes to `<root>/daily_health/day=<date>`, which a repeated run replaces.  Of the facts only the
    day's folder and the columns of the figures are read; what is usual, the mean number of flights, comes
    from the rows that earlier runs kept for the `usual` days before.  `alerts` lists the names of the
    conditions that hold; one that yields NULL, as without earlier days, does not hold.
    """
    path = f"{root}/{HEALTH}"
    facts = read_table_or_empty(spark, f"{root}/fact_flights", STAR_FLIGHTS).select(*READ)
    today = spark.createDataFrame([(day,)], "flight_date date").coalesce(1)
    figures = health(facts.filter(F.col("flight_date") == F.lit(day)), today)
    kept = [f for d, f in day_folders(spark, path, "day").items() if day - dt.timedelta(usual) <= d < day]
    earlier = spark.read.schema(DAILY_HEALTH).parquet(*kept) if kept else spark.createDataFrame([], DAILY_HEALTH)
    raised = [F.when(F.expr(condition), F.lit(name)) for name, condition in alerts.items()]
    judged = (
        figures.withColumn("usual_flights", earlier.agg(F.avg("total_flights")).scalar())
        .withColumn("alerts", F.filter(F.array(*raised), lambda a: a.isNotNull()))
        .withColumn("run_timestamp", F.lit(run_at))
    )
    folder = f"{path}/day={day.isoformat()}"
    replace_table(judged.select(*DAILY_HEALTH.names), folder)
    return read_table(spark, folder, DAILY_HEALTH)


def health_log(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all days that were checked."""
    return read_table_or_empty(spark, f"{root}/{HEALTH}", DAILY_HEALTH)
