"""The order and event tables of the test data, seen as flights, positions and their sources.

Carriers are the market segments and airports the regions.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.times import utc_iso
from skyledger.operators.dimensions import calendar, small_side
from skyledger.operators.flights import stamp_silver
from skyledger.operators.history import first_versions
from skyledger.schemas import DIM_AIRPORT, FLIGHT_COLUMNS

INGESTED_AT = dt.datetime(2002, 1, 1)
FIRST_SNAPSHOT = dt.date(1990, 1, 1)
RUN_DATE = dt.date(2024, 6, 15)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    return spark.read.schema(_schema(path)).parquet(path)


@functools.cache
def _schema(path: str) -> T.StructType:
    """Read from the file footer once; afterwards a scan starts without looking."""
    return SparkSession.active().read.parquet(path).schema


def flights(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of a flight file, typed.

    Orders find their customer first, so that the line items pass through two joins on keys of their
    own and one on the order.  Regions join last: Catalyst knows the size of a plain table and
    broadcasts it or not, but takes a joined side to be as large as the product of its inputs.  For
    the bookings a count stands in for that.
    """
    places = (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "r_name")
    )
    orders = table(spark, folder, "orders")
    bookings = (
        orders.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", F.col("c_mktsegment").alias("carrier_code"), F.col("r_name").alias("dest_airport"))
    )
    joined = (
        table(spark, folder, "lineitem")
        .join(small_side(bookings, within=orders), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, folder, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
        .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumnRenamed("r_name", "origin_airport")
    )
    kind = F.col("l_partkey") % 20
    late = F.col("l_quantity") * 5 - 75

    def cause(which: int) -> Column:
        return F.when((F.col("l_quantity") > 15) & (F.col("l_partkey") % 3 == which), late).otherwise(0.0)

    return joined.select(
        F.col("l_shipdate").cast("date").alias("flight_date"),
        "carrier_code",
        F.concat(F.lit("N"), F.col("l_suppkey")).alias("tail_number"),
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("flight_number"),
        "origin_airport",
        "dest_airport",
        F.when(kind != 0, F.col("l_quantity") * 2 - F.col("l_linenumber") * 10).alias("dep_delay_minutes"),
        F.when(~kind.isin(0, 1), late).alias("arr_delay_minutes"),
        (kind == 0).alias("is_cancelled"),
        (kind == 1).alias("is_diverted"),
        (F.col("p_size") * 50).cast("double").alias("distance_miles"),
        F.when(~kind.isin(0, 1), (F.col("p_size") * 6).cast("double")).alias("air_time_minutes"),
        cause(0).alias("carrier_delay_minutes"),
        cause(1).alias("weather_delay_minutes"),
        cause(2).alias("nas_delay_minutes"),
        F.when(kind == 0, "A").alias("cancellation_code"),
    )


def calendar_table(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar over all years of the flights; their first and last day are looked up now."""
    span = table(spark, folder, "lineitem").agg(
        F.to_date(F.min("l_shipdate")), F.to_date(F.max("l_shipdate"))
    )
    first, last = span.first()
    return calendar(spark, first.replace(month=1, day=1), last.replace(month=12, day=31))


def silver(spark: SparkSession, folder: str) -> DataFrame:
    return stamp_silver(flights(spark, folder), F.lit(INGESTED_AT))


def flight_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Flights as file text, with unreadable delays on long flights and dates on the longest."""
    typed = flights(spark, folder)
    distance = F.col("distance_miles")
    texts = typed.select(*[F.col(c).cast("string").alias(c) for c in FLIGHT_COLUMNS], distance.alias("_miles"))
    return texts.withColumns(
        {
            "dep_delay_minutes": F.when(F.col("_miles") >= 2400, F.lit("oops")).otherwise(
                F.col("dep_delay_minutes")
            ),
            "flight_date": F.when(F.col("_miles") >= 2500, F.lit("notadate")).otherwise(F.col("flight_date")),
        }
    ).drop("_miles")


def carrier_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The carriers of the flights, with names."""
    codes = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("carrier_code")).distinct()
    return codes.withColumn("carrier_name", F.concat(F.initcap("carrier_code"), F.lit(" Air")))


def airport_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The airports of the flights, with names and coordinates."""
    number = F.col("r_regionkey")
    return table(spark, folder, "region").select(
        F.col("r_name").alias("airport_code"),
        F.concat(F.initcap("r_name"), F.lit(" Intl")).alias("airport_name"),
        (number * 10.5 + 1).cast("double").alias("latitude"),
        (number * 20.5 - 40).cast("double").alias("longitude"),
    )


def carriers(spark: SparkSession, folder: str) -> DataFrame:
    rows = carrier_snapshot(spark, folder)
    return first_versions(rows, "carrier_code", ["carrier_name"], "carrier_sk", FIRST_SNAPSHOT)


def airports(spark: SparkSession, folder: str) -> DataFrame:
    tracked = ["airport_name", "latitude", "longitude"]
    return first_versions(airport_snapshot(spark, folder), "airport_code", tracked, "airport_sk", FIRST_SNAPSHOT)


def airport_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Airports that all end on 1998-06-30; three of them go on with a second version."""
    change = dt.date(1998, 7, 1)
    old = airports(spark, folder).withColumns(
        {"effective_to": F.date_sub(F.lit(change), 1), "is_current": F.lit(False)}
    )
    renamed = airport_snapshot(spark, folder).filter(F.col("latitude") < 30)
    new = first_versions(
        renamed.withColumn("airport_name", F.concat("airport_name", F.lit(" II"))),
        "airport_code",
        ["airport_name", "latitude", "longitude"],
        "airport_sk",
        change,
    )
    return old.unionByName(new).select(*DIM_AIRPORT.names)


def supplier_carriers(spark: SparkSession, folder: str) -> DataFrame:
    """A carrier dimension as large as the supplier table."""
    rows = table(spark, folder, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("carrier_code"), F.col("s_name").alias("carrier_name")
    )
    return first_versions(rows, "carrier_code", ["carrier_name"], "carrier_sk", FIRST_SNAPSHOT)


def supplier_carriers_later(spark: SparkSession, folder: str) -> DataFrame:
    """Its later source: overdrawn carriers are gone, some are renamed, some customers are new carriers."""
    suppliers = table(spark, folder, "supplier").filter(F.col("s_acctbal") >= 1000)
    renamed = F.when(F.col("s_nationkey") < 5, F.concat("s_name", F.lit(" Group"))).otherwise(F.col("s_name"))
    kept = suppliers.select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("carrier_code"), renamed.alias("carrier_name")
    )
    added = (
        table(spark, folder, "customer")
        .filter("c_acctbal > 9000")
        .select(F.concat(F.lit("C"), F.col("c_custkey")).alias("carrier_code"), F.col("c_name").alias("carrier_name"))
    )
    return kept.unionByName(added)


def supplier_carriers_seen(spark: SparkSession, folder: str, between: dt.date) -> DataFrame:
    """All snapshots of that dimension with their day `seen`: the two others, and one `between` them.

    It lacks the carriers of some nations, has the later names of others, and some names of its own.
    """
    suppliers = table(spark, folder, "supplier").filter(F.col("s_nationkey") % 4 != 3)
    name = (
        F.when(F.col("s_nationkey") < 3, F.concat("s_name", F.lit(" Group")))
        .when(F.col("s_nationkey") % 4 == 1, F.concat("s_name", F.lit(" Ltd")))
        .otherwise(F.col("s_name"))
    )
    middle = suppliers.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("carrier_code"), name.alias("carrier_name"))
    first = supplier_carriers(spark, folder).select("carrier_code", "carrier_name")
    snapshots = {FIRST_SNAPSHOT: first, between: middle, RUN_DATE: supplier_carriers_later(spark, folder)}
    seen = [rows.withColumn("seen", F.lit(day)) for day, rows in snapshots.items()]
    return functools.reduce(DataFrame.unionByName, seen)


def customer_airports(spark: SparkSession, folder: str) -> DataFrame:
    """An airport dimension as large as the customer table."""
    rows = _customer_airports(spark, folder)
    tracked = ["airport_name", "latitude", "longitude"]
    return first_versions(rows, "airport_code", tracked, "airport_sk", FIRST_SNAPSHOT)


def customer_airports_later(spark: SparkSession, folder: str) -> DataFrame:
    """Its later source: some airports moved, some closed, the suppliers are new airports."""
    moved = F.when(F.col("latitude") >= 20, F.col("longitude") + 0.5).otherwise(F.col("longitude"))
    kept = _customer_airports(spark, folder).filter("latitude <> 3").withColumn("longitude", moved)
    added = table(spark, folder, "supplier").select(
        F.concat(F.lit("B"), F.col("s_suppkey")).alias("airport_code"),
        F.col("s_name").alias("airport_name"),
        F.col("s_nationkey").cast("double").alias("latitude"),
        F.lit(0.0).alias("longitude"),
    )
    return kept.unionByName(added)


def _customer_airports(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.concat(F.lit("A"), F.col("c_custkey")).alias("airport_code"),
        F.col("c_name").alias("airport_name"),
        F.col("c_nationkey").cast("double").alias("latitude"),
        F.when(F.col("c_mktsegment") == "BUILDING", 2.0).otherwise(-2.0).alias("longitude"),
    )


def _event_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the number `k` of their properties.  Their times carry no zone and are taken as UTC."""
    return table(spark, folder, "events").select(
        "event_id",
        F.concat(F.col("ts").cast("string"), F.lit("+00:00")).cast("timestamp").alias("polled_at"),
        "user_id",
        "event_type",
        F.floor("value").alias("knots"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def raw_positions(spark: SparkSession, folder: str) -> DataFrame:
    """One raw position per event."""
    return _event_fields(spark, folder).select(
        F.concat(F.lit("F"), F.col("event_id")).alias("fr24_id"),
        F.lpad(F.hex("user_id"), 6, "0").alias("hex"),
        F.lit(None).cast("string").alias("icao24"),
        F.concat(F.upper("event_type"), F.col("user_id")).alias("callsign"),
        (F.col("user_id") % 20 + 45).cast("double").alias("lat"),
        (F.col("user_id") % 23 - 10).cast("double").alias("lon"),
        (F.col("k") * 400).alias("alt"),
        F.col("knots").alias("gspeed"),
        (F.col("k") - 50).alias("vspeed"),
        (F.col("k") == 0).alias("on_ground"),
        utc_iso(F.col("polled_at")).alias("ingestion_timestamp"),
    )


def position_responses(spark: SparkSession, folder: str) -> DataFrame:
    """One response per event, holding none to three positions."""
    events = _event_fields(spark, folder).withColumn("n", F.col("k") % 4)

    def position(i: Column) -> Column:
        return F.struct(
            F.concat_ws("-", F.col("event_id"), i).alias("fr24_id"),
            F.lpad(F.hex("user_id"), 6, "0").alias("hex"),
            F.when(F.col("event_type") != "error", F.concat(F.upper("event_type"), F.col("user_id"))).alias(
                "callsign"
            ),
            (F.col("user_id") % 20 + 45 + i * 0.25).cast("double").alias("lat"),
            (F.col("user_id") % 23 - 10).cast("double").alias("lon"),
            (F.col("k") * 400 + i).alias("alt"),
            F.col("knots").alias("gspeed"),
            (F.col("k") - 50).alias("vspeed"),
            F.lit("B77W").alias("type"),
        )

    numbers = F.sequence(F.lit(1).cast("bigint"), F.greatest("n", F.lit(1)))
    data = F.slice(F.transform(numbers, position), F.lit(1), F.col("n").cast("int"))
    response = F.struct(data.alias("data"), F.struct(F.col("n").alias("count")).alias("meta"))
    return events.select(F.to_json(response, {"ignoreNullFields": "false"}).alias("payload"), "polled_at")


def state_responses(spark: SparkSession, folder: str) -> DataFrame:
    """One response per event: no list, a full vector, a short one, or one with a surplus value."""
    events = _event_fields(spark, folder)
    full = F.format_string(
        '["%s","%s",null,%d,%d,%d.5,%d.25,%d,%s,%d,null,-1.5,[1,%d],null,"7000",false,0,%d]',
        F.lower(F.lpad(F.hex("user_id"), 6, "0")),
        F.upper("event_type"),
        F.unix_timestamp("polled_at"),
        F.unix_timestamp("polled_at"),
        F.col("user_id") % 23,
        F.col("user_id") % 20 + 45,
        F.col("k") * 100,
        F.when(F.col("k") == 0, "true").otherwise("false"),
        F.col("knots"),
        F.col("k"),
        F.col("k") % 9,
    )
    short = F.format_string('["%s"]', F.lower(F.lpad(F.hex("user_id"), 6, "0")))
    surplus = F.concat(F.substr(full, F.lit(1), F.length(full) - 1), F.lit(',"surplus"]'))
    states = (
        F.when(F.col("event_type") == "error", F.lit("null"))
        .when(F.col("event_type") == "view", F.concat(F.lit("["), full, F.lit(","), short, F.lit("]")))
        .when(F.col("event_type") == "click", F.concat(F.lit("["), surplus, F.lit("]")))
        .otherwise(F.concat(F.lit("["), full, F.lit("]")))
    )
    payload = F.concat(F.lit('{"time":0,"states":'), states, F.lit("}"))
    return events.select(payload.alias("payload"), "polled_at")
