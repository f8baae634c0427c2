"""Flight files to silver, and silver to the flight facts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.delays import gold_category, total_delay, warehouse_category
from skyledger.functions.keys import route_key, row_hash, surrogate_key
from skyledger.operators.dimensions import is_small, lookup
from skyledger.schemas import BROKEN_LINE, FLIGHT_COLUMNS, SILVER_FLIGHTS, STAR_FLIGHTS

FLIGHT_KEY = ("carrier_code", "flight_number", "flight_date", "origin_airport", "dest_airport")


def stamp_silver(flights: DataFrame, ingested_at: Column) -> DataFrame:
    """Add the change-detection hash and the ingestion stamp to typed flights."""
    return flights.select(
        *FLIGHT_COLUMNS,
        row_hash(*FLIGHT_COLUMNS).alias("row_hash"),
        ingested_at.cast("timestamp").alias("ingestion_timestamp"),
    )


def parse_flights(
    raw: DataFrame, rename: Mapping[str, str] | None = None, date_format: str = "yyyy-MM-dd"
) -> DataFrame:
    """Type the text columns of flight files.

    `rename` maps file headers to silver names.  A cell whose text does not parse becomes NULL and
    its column name is listed in `rejected_columns`, so that bad rows can be split off and counted; a
    line with a wrong number of cells lists `BROKEN_LINE`.  Flags may be words or numbers such as 1.00.
    """
    named = raw.withColumnsRenamed(dict(rename or {}))
    typed = []
    faults = []
    for name in FLIGHT_COLUMNS:
        text = F.col(name)
        kind = SILVER_FLIGHTS[name].dataType
        if kind.typeName() == "string":
            typed.append(text)
            continue
        if kind.typeName() == "date":
            value = F.try_to_date(text, date_format)
        elif kind.typeName() == "boolean":
            value = F.coalesce(text.try_cast(kind), text.try_cast("double") != 0)
        else:
            value = text.try_cast(kind)
        typed.append(value.alias(name))
        faults.append(F.when(text.isNotNull() & value.isNull(), F.lit(name)))
    if BROKEN_LINE in raw.columns:
        faults.append(F.when(F.col(BROKEN_LINE).isNotNull(), F.lit(BROKEN_LINE)))
    return named.select(*typed, F.array_compact(F.array(*faults)).alias("rejected_columns"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.size("rejected_columns") == 0).drop("rejected_columns")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.size("rejected_columns") > 0)


def fact_flights(silver: DataFrame) -> DataFrame:
    """Silver plus total delay, delay category, route key and surrogate key.

    Two projections that Catalyst merges into one; no shuffle.
    """
    total = total_delay(F.col("arr_delay_minutes"), F.col("is_cancelled"))
    return silver.withColumn("total_delay_minutes", total).withColumns(
        {
            "delay_category": gold_category(
                F.col("total_delay_minutes"), F.col("is_cancelled"), F.col("is_diverted")
            ),
            "route_key": route_key("origin_airport", "dest_airport"),
            "flight_surrogate_key": surrogate_key(*FLIGHT_KEY),
        }
    )


def star_flights(
    silver: DataFrame,
    dates: DataFrame,
    carriers: DataFrame,
    airports: DataFrame,
    as_of_flight: bool = False,
    unknown_delay: str | None = None,
) -> DataFrame:
    """Star-schema facts: dimension keys, warehouse delay category.

    Keys come from the current dimension versions, or, with `as_of_flight`, from the versions valid
    on the flight date.  The airport dimension plays two roles.  Flights without a match keep NULL.
    """
    valid_on = "flight_date" if as_of_flight else None
    if not as_of_flight:
        carriers, airports = carriers.filter("is_current"), airports.filter("is_current")
    facts = silver.withColumns(
        {
            "flight_sk": surrogate_key(*FLIGHT_KEY),
            "delay_category": warehouse_category(F.col("arr_delay_minutes"), unknown_delay),
        }
    ).withColumnsRenamed({"origin_airport": "origin_airport_code", "dest_airport": "dest_airport_code"})
    facts = lookup(facts, dates, "flight_date", "full_date", {"date_sk": "date_sk"})
    facts = lookup(facts, carriers, "carrier_code", "carrier_code", {"carrier_sk": "carrier_sk"}, valid_on)
    few_airports = is_small(airports)
    for role in ("origin", "dest"):
        facts = lookup(
            facts,
            airports,
            f"{role}_airport_code",
            "airport_code",
            {"airport_sk": f"{role}_airport_sk"},
            valid_on,
            small=few_airports,
        )
    return facts.select(*STAR_FLIGHTS.names)
