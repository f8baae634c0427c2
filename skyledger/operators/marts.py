"""Aggregates over flights.

Every mart is one grouped aggregation, so rows are combined before the single shuffle and a hot
route or carrier costs one partial result per task.  Dimension attributes join afterwards, to the
small aggregate.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.delays import SEVERE_MINUTES, WAREHOUSE_BANDS, warehouse_category
from skyledger.functions.rates import complement, share
from skyledger.operators.dimensions import lookup

ON_TIME = WAREHOUSE_BANDS[0][1]
SEVERE = WAREHOUSE_BANDS[-1][1]

ROUTE = ["origin_airport", "dest_airport", "carrier_code"]
PART_SUMS = ["flights", "arr_delay_sum", "arr_delay_count", "on_time", "severe"]

CAUSES = ("carrier", "weather", "nas")

# Grain of a mart -> name and expression of its period column.
PERIODS = {
    "day": ("flight_date", lambda: F.col("flight_date")),
    "month": ("flight_month", lambda: F.trunc("flight_date", "month")),
}


def _period(grain: str | None) -> list[Column]:
    if grain is None:
        return []
    name, expression = PERIODS[grain]
    return [expression().alias(name)]


def route_performance(silver: DataFrame, grain: str | None = "day") -> DataFrame:
    """Per period, carrier and route: volume, average and quantile delays, on-time rate.

    Cancelled flights and flights with an unknown cancelled flag are left out.  A flight is on time
    here unless it is known to be more than an hour late.
    """
    keys = [*_period(grain), F.col("carrier_code"), F.col("origin_airport"), F.col("dest_airport")]
    late = F.col("arr_delay_minutes")
    grouped = (
        silver.filter(~F.col("is_cancelled"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_flights"),
            F.avg("dep_delay_minutes").alias("avg_dep_delay_minutes"),
            F.avg(late).alias("avg_arr_delay_minutes"),
            # Both quantiles from one sketch: half the state and half the merging.
            F.percentile_approx(late, [0.5, 0.95]).alias("quantiles"),
            F.avg("distance_miles").alias("avg_distance_miles"),
            F.count_if(late > SEVERE_MINUTES).alias("severe_delay_count"),
        )
    )
    names = [n for n in grouped.columns if n not in ("quantiles", "avg_distance_miles", "severe_delay_count")]
    return grouped.select(
        *names,
        F.col("quantiles")[0].alias("median_arr_delay_minutes"),
        F.col("quantiles")[1].alias("p95_arr_delay_minutes"),
        "avg_distance_miles",
        "severe_delay_count",
        complement(F.col("severe_delay_count"), F.col("total_flights")).alias("on_time_rate"),
    )


def carrier_daily(flights: DataFrame, carriers: DataFrame, key: str = "carrier_code") -> DataFrame:
    """Per carrier, carrier name and day: volume, cancellations, average delays, on-time and severe counts.

    `key` is "carrier_code", for the current name of each carrier, or "carrier_sk", for the name in the
    dimension version that the facts refer to.  Flights are summed per key and day first; the second
    grouping only merges versions that share a name, on the partitioning that is there.
    """
    category = warehouse_category(F.col("arr_delay_minutes"))
    summed = flights.groupBy("carrier_code", "flight_date", *([key] if key != "carrier_code" else [])).agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.count_if("is_cancelled").alias("cancelled_flights"),
        F.sum("dep_delay_minutes").alias("dep_sum"),
        F.count("dep_delay_minutes").alias("dep_count"),
        F.sum("arr_delay_minutes").alias("arr_sum"),
        F.count("arr_delay_minutes").alias("arr_count"),
        F.count_if(category == ON_TIME).alias("on_time_count"),
        F.count_if(category == SEVERE).alias("severe_delay_count"),
    )
    return _carrier_days(summed, carriers, key)


def _carrier_days(summed: DataFrame, carriers: DataFrame, key: str) -> DataFrame:
    """Sums per carrier key and day, named, those with one name put together, with rates."""
    versions = carriers.filter("is_current") if key == "carrier_code" else carriers
    named = lookup(summed, versions, key, key, {"carrier_name": "carrier_name"})
    keys = ["carrier_code", "carrier_name", "flight_date"]
    sums = [c for c in summed.columns if c not in (*keys, key)]
    total = F.col("total_flights")
    return (
        named.groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in sums])
        .select(
            *keys,
            total,
            "cancelled_flights",
            share(F.col("cancelled_flights"), total).alias("cancellation_rate"),
            F.try_divide("dep_sum", "dep_count").alias("avg_dep_delay"),
            F.try_divide("arr_sum", "arr_count").alias("avg_arr_delay"),
            "on_time_count",
            share(F.col("on_time_count"), total).alias("on_time_rate"),
            "severe_delay_count",
        )
    )


def route_parts(flights: DataFrame, by_day: bool = True) -> DataFrame:
    """Sums and counts per route and carrier, from which an average or share of any span follows.

    Kept per day and month, they let the all-time mart follow new flights without reading old ones
    again.
    """
    category = warehouse_category(F.col("arr_delay_minutes"))
    return flights.groupBy(*(["flight_date"] if by_day else []), *ROUTE).agg(
        F.count(F.lit(1)).alias("flights"),
        F.sum("arr_delay_minutes").alias("arr_delay_sum"),
        F.count("arr_delay_minutes").alias("arr_delay_count"),
        F.count_if(category == ON_TIME).alias("on_time"),
        F.count_if(category == SEVERE).alias("severe"),
    )


def monthly_parts(parts: DataFrame) -> DataFrame:
    """Daily parts summed per month."""
    month = F.trunc("flight_date", "month").alias("flight_month")
    return parts.groupBy(month, *ROUTE).agg(*[F.sum(m).alias(m) for m in PART_SUMS])


def route_overview(parts: DataFrame, airports: DataFrame) -> DataFrame:
    """Per route and carrier over all time, with names and coordinates of both airports.

    The share of severe delays is a percentage, the on-time rate a fraction.
    """
    summed = parts.groupBy(*ROUTE).agg(*[F.sum(m).alias(m) for m in PART_SUMS])
    total = F.col("flights")
    rated = summed.select(
        *ROUTE,
        total.alias("total_flights"),
        F.try_divide("arr_delay_sum", "arr_delay_count").alias("avg_arr_delay"),
        share(F.col("on_time"), total).alias("on_time_rate"),
        share(F.col("severe") * 100.0, total).alias("pct_severe_delays"),
    )
    return with_airports(rated, airports.filter("is_current"))


def with_airports(routes: DataFrame, airports: DataFrame) -> DataFrame:
    """Name and coordinates of the origin and of the destination: one dimension in two roles."""
    for role in ("origin", "dest"):
        take = {
            "airport_name": f"{role}_name",
            "latitude": f"{role}_latitude",
            "longitude": f"{role}_longitude",
        }
        routes = lookup(routes, airports, f"{role}_airport", "airport_code", take)
    return routes


def delay_analysis(flights: DataFrame) -> DataFrame:
    """Per carrier and month: averages and shares of the delay causes, where there is any delay."""
    causes = {c: F.col(f"{c}_delay_minutes") for c in CAUSES}
    minutes = {c: F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{c}_minutes") for c, v in causes.items()}
    grouped = flights.groupBy("carrier_code", F.trunc("flight_date", "month").alias("flight_month")).agg(
        *[F.avg(v).alias(f"avg_{c}_delay") for c, v in causes.items()],
        *minutes.values(),
    )
    return _cause_shares(grouped)


def _cause_shares(grouped: DataFrame) -> DataFrame:
    """Shares of the causes' minutes, where there are any."""
    grouped = grouped.withColumn("total_delay_minutes", sum((F.col(f"{c}_minutes") for c in CAUSES), F.lit(0.0)))
    total = F.col("total_delay_minutes")
    return grouped.filter(total > 0).select(
        "carrier_code",
        "flight_month",
        *[f"avg_{c}_delay" for c in CAUSES],
        total,
        share(F.col("weather_minutes"), total).alias("weather_delay_share"),
        share(F.col("carrier_minutes"), total).alias("carrier_delay_share"),
    )


# Parts under signed changes.  Minutes are summed as whole millionths, so that what was added and taken
# away again leaves nothing behind.

MILLIONTHS = 1_000_000
CARRIER_SUMS = [
    "total_flights", "cancelled_flights", "dep_sum", "dep_count", "arr_sum", "arr_count", "on_time_count", "severe_delay_count",
]
CAUSE_SUMS = [f"{c}_{kind}" for c in CAUSES for kind in ("minutes", "count")]


def _minutes(value: str) -> Column:
    return F.coalesce(F.sum(F.col("sign") * F.round(F.col(value) * MILLIONTHS).cast("bigint")), F.lit(0))


def _number(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("sign")).otherwise(0))


def carrier_parts(changes: DataFrame) -> DataFrame:
    """What signed changes of flights add to the sums of each carrier version and day."""
    category = warehouse_category(F.col("arr_delay_minutes"))
    return changes.groupBy("flight_date", "carrier_code", "carrier_sk").agg(
        F.sum("sign").alias("total_flights"),
        _number(F.col("is_cancelled")).alias("cancelled_flights"),
        _minutes("dep_delay_minutes").alias("dep_sum"),
        _number(F.col("dep_delay_minutes").isNotNull()).alias("dep_count"),
        _minutes("arr_delay_minutes").alias("arr_sum"),
        _number(F.col("arr_delay_minutes").isNotNull()).alias("arr_count"),
        _number(category == ON_TIME).alias("on_time_count"),
        _number(category == SEVERE).alias("severe_delay_count"),
    )


def carrier_daily_of(parts: DataFrame, carriers: DataFrame) -> DataFrame:
    """`carrier_daily` by carrier version, from any number of parts."""
    keys = ["carrier_code", "flight_date", "carrier_sk"]
    summed = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in CARRIER_SUMS]).filter("total_flights <> 0")
    return _carrier_days(_as_minutes(summed, "dep_sum", "arr_sum"), carriers, "carrier_sk")


def route_changes(changes: DataFrame) -> DataFrame:
    """What signed changes of flights add to the sums of each route, carrier and month."""
    category = warehouse_category(F.col("arr_delay_minutes"))
    named = changes.withColumnsRenamed({"origin_airport_code": "origin_airport", "dest_airport_code": "dest_airport"})
    return named.groupBy(F.trunc("flight_date", "month").alias("flight_month"), *ROUTE).agg(
        F.sum("sign").alias("flights"),
        _minutes("arr_delay_minutes").alias("arr_delay_sum"),
        _number(F.col("arr_delay_minutes").isNotNull()).alias("arr_delay_count"),
        _number(category == ON_TIME).alias("on_time"),
        _number(category == SEVERE).alias("severe"),
    )


def route_sums(parts: DataFrame) -> DataFrame:
    """The all-time sums that `route_overview` takes, from any number of parts."""
    summed = parts.groupBy(*ROUTE).agg(*[F.sum(m).alias(m) for m in PART_SUMS]).filter("flights <> 0")
    return _as_minutes(summed, "arr_delay_sum")


def cause_parts(changes: DataFrame) -> DataFrame:
    """What signed changes of flights add to the minutes and counts of each carrier's delay causes in a month."""
    sums = [
        column
        for c in CAUSES
        for column in (
            _minutes(f"{c}_delay_minutes").alias(f"{c}_minutes"),
            _number(F.col(f"{c}_delay_minutes").isNotNull()).alias(f"{c}_count"),
        )
    ]
    return changes.groupBy(F.trunc("flight_date", "month").alias("flight_month"), "carrier_code").agg(
        F.sum("sign").alias("flights"), *sums
    )


def delay_analysis_of(parts: DataFrame) -> DataFrame:
    """`delay_analysis` from any number of parts."""
    summed = parts.groupBy("carrier_code", "flight_month").agg(*[F.sum(c).alias(c) for c in ("flights", *CAUSE_SUMS)])
    minutes = _as_minutes(summed.filter("flights <> 0"), *[f"{c}_minutes" for c in CAUSES])
    averages = {f"avg_{c}_delay": F.try_divide(F.col(f"{c}_minutes"), F.col(f"{c}_count")) for c in CAUSES}
    return _cause_shares(minutes.withColumns(averages))


def _as_minutes(summed: DataFrame, *columns: str) -> DataFrame:
    return summed.withColumns({c: F.col(c) / MILLIONTHS for c in columns})


def headline_measures() -> list[Column]:
    """Total flights, average delay, on-time rate, cancellation rate."""
    total = F.count(F.lit(1))
    on_time = F.count_if(warehouse_category(F.col("arr_delay_minutes")) == ON_TIME)
    return [
        total.alias("total_flights"),
        F.avg("arr_delay_minutes").alias("avg_arr_delay"),
        share(on_time, total).alias("on_time_rate"),
        share(F.count_if("is_cancelled"), total).alias("cancellation_rate"),
    ]


def scorecards(flights: DataFrame) -> DataFrame:
    return flights.agg(*headline_measures())


def daily_trend(flights: DataFrame) -> DataFrame:
    return flights.groupBy("flight_date").agg(*headline_measures())


def daily_stats(flights: DataFrame, day: dt.date | None = None) -> DataFrame:
    """Health figures of one day, or of every day: volume, average delay, cancellations, severe delays."""
    scope = flights if day is None else flights.filter(F.col("flight_date") == F.lit(day))
    severe = warehouse_category(F.col("arr_delay_minutes")) == SEVERE
    return scope.groupBy("flight_date").agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.avg("arr_delay_minutes").alias("avg_delay_minutes"),
        F.count_if("is_cancelled").alias("cancelled_flights"),
        F.count_if(severe).alias("severe_delay_count"),
    )
