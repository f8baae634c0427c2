"""Daily delay sketches below the warehouse, and what is rolled up from them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from skyledger.operators.loading import days_of, on_days
from skyledger.operators.sketches import daily_sketches, route_rollup
from skyledger.schemas import ROUTE_SKETCHES, STAR_FLIGHTS
from skyledger.sources.tables import read_table, read_table_or_empty
from skyledger.sources.writers import Written, staged, write_by_date

SKETCHES = "route_sketches"


def refresh_sketches(spark: SparkSession, root: str, days: Sequence[dt.date | None] | None = None) -> Written:
    """Sketch the facts of some days anew, or of all; a sketch can not give values back, so a day is redone whole."""
    facts = read_table(spark, f"{root}/fact_flights", STAR_FLIGHTS)
    days = days_of(facts, "flight_date") if days is None else days
    named = on_days(facts, days, "flight_date").withColumnsRenamed(
        {"origin_airport_code": "origin_airport", "dest_airport_code": "dest_airport"}
    )
    sketched = staged(daily_sketches(named), "sketches")
    return write_by_date(sketched, f"{root}/{SKETCHES}", "flight_date", ["origin_airport"], rebuilt=days, spread=True)


def rolled_up(spark: SparkSession, root: str) -> DataFrame:
    """Quantiles per month and over all time from the stored sketches."""
    return route_rollup(read_table_or_empty(spark, f"{root}/{SKETCHES}", ROUTE_SKETCHES))
