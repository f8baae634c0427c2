"""Schemas of every table.  Readers always pass one; nothing is inferred from files.

Column names, types and order are fixed values: other programs read and write these tables.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "DOUBLE": T.DoubleType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "BOOLEAN": T.BooleanType(),
    "STRINGS": T.ArrayType(T.StringType()),
    "BINARY": T.BinaryType(),
}


def struct(columns: str) -> T.StructType:
    """Schema from `name TYPE, ...`; unlike `fromDDL` it needs no running session."""
    fields = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


SILVER_FLIGHTS = struct(
    """flight_date DATE, carrier_code STRING, tail_number STRING, flight_number STRING,
       origin_airport STRING, dest_airport STRING,
       dep_delay_minutes DOUBLE, arr_delay_minutes DOUBLE,
       is_cancelled BOOLEAN, is_diverted BOOLEAN,
       distance_miles DOUBLE, air_time_minutes DOUBLE,
       carrier_delay_minutes DOUBLE, weather_delay_minutes DOUBLE, nas_delay_minutes DOUBLE,
       cancellation_code STRING, row_hash STRING, ingestion_timestamp TIMESTAMP"""
)

# What a flight file delivers: the silver columns before hash and stamp are added.
FLIGHT_COLUMNS = [n for n in SILVER_FLIGHTS.names if n not in ("row_hash", "ingestion_timestamp")]

# Where readers put a line that does not fit.
BROKEN_LINE = "broken_line"

# Parsed flight files by month, with the columns whose text did not parse.
STAGED_FLIGHTS = T.StructType(
    [SILVER_FLIGHTS[n] for n in FLIGHT_COLUMNS]
    + struct("rejected_columns STRINGS, year INT, month INT").fields
)

FACT_FLIGHTS = T.StructType(
    SILVER_FLIGHTS.fields
    + struct(
        """total_delay_minutes DOUBLE, delay_category STRING, route_key STRING,
           flight_surrogate_key STRING"""
    ).fields
)

ROUTE_PERFORMANCE = struct(
    """flight_date DATE, carrier_code STRING, origin_airport STRING, dest_airport STRING,
       total_flights BIGINT, avg_dep_delay_minutes DOUBLE, avg_arr_delay_minutes DOUBLE,
       median_arr_delay_minutes DOUBLE, p95_arr_delay_minutes DOUBLE, avg_distance_miles DOUBLE,
       severe_delay_count BIGINT, on_time_rate DOUBLE"""
)

# One live position as received.  Feeds disagree on the aircraft address: `hex` or `icao24`.
RAW_POSITION = struct(
    """fr24_id STRING, hex STRING, icao24 STRING, callsign STRING, lat DOUBLE, lon DOUBLE,
       alt BIGINT, gspeed BIGINT, vspeed BIGINT, on_ground BOOLEAN, ingestion_timestamp STRING"""
)

# A state vector is positional: these names follow the feed's positions 0..17.
STATE_VECTOR = struct(
    """icao24 STRING, callsign STRING, origin_country STRING, time_position BIGINT,
       last_contact BIGINT, longitude DOUBLE, latitude DOUBLE, baro_altitude DOUBLE,
       on_ground BOOLEAN, velocity DOUBLE, true_track DOUBLE, vertical_rate DOUBLE,
       sensors STRING, geo_altitude DOUBLE, squawk STRING, spi BOOLEAN,
       position_source INT, category INT"""
)

FACT_POSITIONS = struct(
    """position_sk STRING, date_sk STRING, icao24 STRING, callsign STRING,
       latitude DOUBLE, longitude DOUBLE, altitude_metres DOUBLE, velocity_ms DOUBLE,
       vertical_speed DOUBLE, on_ground BOOLEAN, ingestion_timestamp TIMESTAMP,
       position_date DATE"""
)

# What could not be landed.
REJECTED_PAYLOADS = struct("payload STRING, polled_at TIMESTAMP, reason STRING")

DIM_DATE = struct(
    """date_sk STRING, full_date DATE, year INT, month INT, day_of_month INT,
       day_name STRING, month_name STRING, quarter INT, is_weekend BOOLEAN"""
)

DIM_CARRIER = struct(
    """carrier_sk STRING, carrier_code STRING, carrier_name STRING, row_hash STRING,
       effective_from DATE, effective_to DATE, is_current BOOLEAN"""
)

DIM_AIRPORT = struct(
    """airport_sk STRING, airport_code STRING, airport_name STRING, latitude DOUBLE,
       longitude DOUBLE, row_hash STRING, effective_from DATE, effective_to DATE,
       is_current BOOLEAN"""
)

STAR_FLIGHTS = struct(
    """flight_sk STRING, date_sk STRING, carrier_sk STRING, origin_airport_sk STRING,
       dest_airport_sk STRING, flight_date DATE, carrier_code STRING,
       origin_airport_code STRING, dest_airport_code STRING,
       dep_delay_minutes DOUBLE, arr_delay_minutes DOUBLE, distance_miles DOUBLE,
       air_time_minutes DOUBLE, is_cancelled BOOLEAN, is_diverted BOOLEAN,
       delay_category STRING, carrier_delay_minutes DOUBLE, weather_delay_minutes DOUBLE,
       nas_delay_minutes DOUBLE"""
)

ROUTE_PARTS = struct(
    """flight_date DATE, origin_airport STRING, dest_airport STRING, carrier_code STRING,
       flights BIGINT, arr_delay_sum DOUBLE, arr_delay_count BIGINT, on_time BIGINT, severe BIGINT"""
)

MONTHLY_ROUTE_PARTS = T.StructType(
    [T.StructField("flight_month", T.DateType()), *ROUTE_PARTS.fields[1:]]
)

# What a load changes in the flight facts, and what that adds to the sums behind the marts; minutes of
# parts are whole millionths.
FLIGHT_CHANGES = T.StructType([*STAR_FLIGHTS.fields, T.StructField("sign", T.IntegerType())])

CARRIER_PARTS = struct(
    """flight_date DATE, carrier_code STRING, carrier_sk STRING, total_flights BIGINT,
       cancelled_flights BIGINT, dep_sum BIGINT, dep_count BIGINT, arr_sum BIGINT, arr_count BIGINT,
       on_time_count BIGINT, severe_delay_count BIGINT"""
)

ROUTE_CHANGES = struct(
    """flight_month DATE, origin_airport STRING, dest_airport STRING, carrier_code STRING,
       flights BIGINT, arr_delay_sum BIGINT, arr_delay_count BIGINT, on_time BIGINT, severe BIGINT"""
)

CAUSE_PARTS = struct(
    """flight_month DATE, carrier_code STRING, flights BIGINT, carrier_minutes BIGINT,
       carrier_count BIGINT, weather_minutes BIGINT, weather_count BIGINT, nas_minutes BIGINT,
       nas_count BIGINT"""
)

ROUTE_SKETCHES = struct(
    """flight_date DATE, origin_airport STRING, dest_airport STRING, carrier_code STRING,
       flights BIGINT, arr_delay_sum DOUBLE, arr_delay_count BIGINT, delays BINARY"""
)

ROUTE_OVERVIEW = struct(
    """origin_airport STRING, dest_airport STRING, carrier_code STRING, total_flights BIGINT,
       avg_arr_delay DOUBLE, on_time_rate DOUBLE, pct_severe_delays DOUBLE, origin_name STRING,
       origin_latitude DOUBLE, origin_longitude DOUBLE, dest_name STRING, dest_latitude DOUBLE,
       dest_longitude DOUBLE"""
)

DELAY_ANALYSIS = struct(
    """carrier_code STRING, flight_month DATE, avg_carrier_delay DOUBLE, avg_weather_delay DOUBLE,
       avg_nas_delay DOUBLE, total_delay_minutes DOUBLE, weather_delay_share DOUBLE,
       carrier_delay_share DOUBLE"""
)

RUN_LOG = struct(
    """run_id STRING, run_date DATE, run_timestamp TIMESTAMP, source STRING,
       total_rows_loaded BIGINT, rows_rejected BIGINT, avg_delay_minutes DOUBLE,
       gemini_summary STRING, pipeline_status STRING, created_at TIMESTAMP"""
)
# Who has which role.
ROLE_MEMBERS = struct("user_name STRING, role STRING")
_VOLUMES = T.ArrayType(struct("carrier_code STRING, total_flights BIGINT"))
# The health of a day, as the daily run found it.
DAILY_HEALTH = T.StructType(
    [
        *struct(
            """flight_date DATE, total_flights BIGINT, cancelled_flights BIGINT, severe_delay_count BIGINT,
               avg_delay_minutes DOUBLE"""
        ).fields,
        T.StructField("top_carriers", _VOLUMES),
        *struct("usual_flights DOUBLE, alerts STRINGS, run_timestamp TIMESTAMP").fields,
    ]
)
