"""Aircraft positions: raw feed records to the position facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.geo import NORTH_WEST_EUROPE, BoundingBox
from skyledger.functions.keys import date_key, row_hash, surrogate_key
from skyledger.functions.times import utc_date
from skyledger.functions.units import feet_to_metres, knots_to_ms
from skyledger.schemas import FACT_POSITIONS


def within(raw: DataFrame, box: BoundingBox = NORTH_WEST_EUROPE) -> DataFrame:
    """Raw positions inside the box; a position without coordinates is outside."""
    return raw.filter(box.contains(F.col("lat"), F.col("lon")))


def silver_positions(raw: DataFrame) -> DataFrame:
    """Silver names and units: feet to metres, knots to metres per second."""
    return raw.select(
        "fr24_id",
        F.coalesce("hex", "icao24").alias("icao24"),
        "callsign",
        F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"),
        feet_to_metres(F.col("alt")).alias("altitude_metres"),
        knots_to_ms(F.col("gspeed")).alias("velocity_ms"),
        F.col("vspeed").cast("double").alias("vertical_speed"),
        "on_ground",
        F.col("ingestion_timestamp").try_cast("timestamp").alias("ingestion_timestamp"),
    )


def fact_positions(silver: DataFrame) -> DataFrame:
    """One row per position record, keyed by flight id and ingestion time in microseconds.

    A record without flight id is known by its content instead.  The date is that of UTC in every
    session.
    """
    stamped = F.col("ingestion_timestamp")
    day = utc_date(stamped)
    flight = F.coalesce("fr24_id", row_hash("icao24", "callsign", "latitude", "longitude"))
    return silver.withColumns(
        {
            "position_sk": surrogate_key(flight, F.unix_micros(stamped)),
            "date_sk": date_key(day),
            "position_date": day,
        }
    ).select(*FACT_POSITIONS.names)
