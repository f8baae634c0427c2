"""Every query by name: callables from (session, folder of the test tables) to a DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.delays import warehouse_category
from skyledger.operators import (
    audit,
    dimensions,
    filters,
    flights,
    history,
    loading,
    marts,
    masking,
    positions,
    quality,
    ranking,
    sketches,
)
from skyledger.schemas import (
    BROKEN_LINE,
    DELAY_ANALYSIS,
    FACT_POSITIONS,
    FLIGHT_COLUMNS,
    REJECTED_PAYLOADS,
    ROUTE_OVERVIEW,
    ROUTE_PERFORMANCE,
    RUN_LOG,
    SILVER_FLIGHTS,
    STAR_FLIGHTS,
)
from skyledger.plans import warehouse
from skyledger.plans.access import READS_SENSITIVE
from skyledger.plans.gold import silver_to_gold
from skyledger.plans.health import health
from skyledger.plans.ingest import REJECTED, land_positions
from skyledger.session import work_folder
from skyledger.sources import payloads, stores, tables, testbed, writers
from skyledger.streaming.positions import stream_positions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The table before a load, and the overlapping batch that arrives next.
LOADED_UNTIL = dt.date(2001, 6, 1)
REFRESHED_UNTIL = dt.date(2001, 6, 15)
BATCH_FROM = dt.date(2001, 1, 1)
BATCH_UNTIL = dt.date(2002, 12, 31)
RETENTION_RUN = dt.date(2000, 9, 1)
EMPTIED = dt.date(1997, 6, 1)
RERUN_AT = dt.datetime(2002, 1, 2, 6)
CORRECTED_AT = dt.datetime(2002, 2, 1)
LATE_SNAPSHOT = dt.date(2010, 3, 1)
REPORT_RUN = dt.date(2000, 9, 15)
MASK_KEY = "a key for the check"


def query(function: Query) -> Query:
    QUERIES[function.__name__.removesuffix("_")] = function
    return function


# Sources and layout


@query
def scan_silver(spark, folder):
    path = work_folder(spark, "silver")
    writers.append_table(testbed.silver(spark, folder), path)
    return tables.read_table(spark, path, SILVER_FLIGHTS)


@query
def partition_scan(spark, folder):
    path = work_folder(spark, "silver_by_date")
    writers.write_by_date(testbed.silver(spark, folder), path, "flight_date", ["carrier_code", "origin_airport"])
    return tables.read_table(spark, path, SILVER_FLIGHTS).select(
        "flight_date", "carrier_code", "flight_number", "origin_airport", "dest_airport", "arr_delay_minutes"
    )


@query
def csv_scan(spark, folder):
    """The files also hold lines with too few and too many cells, which are rejected."""
    path = work_folder(spark, "flight_files")
    texts = testbed.flight_texts(spark, folder)
    writers.write_flight_files(texts, path)
    cells = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in texts.columns[:7]])
    short = texts.select(cells.alias("value"))
    long = short.select(F.concat("value", F.lit("," * len(texts.columns))).alias("value"))
    writers.append_lines(short.unionByName(long), ",".join(texts.columns), path)
    parsed = flights.parse_flights(tables.read_flight_files(spark, path, FLIGHT_COLUMNS))
    return flights.accepted(parsed)


@query
def ndjson_scan(spark, folder):
    path = work_folder(spark, "landing")
    landed = land_positions(testbed.position_responses(spark, folder), path)
    read = tables.read_positions(spark, landed.path)
    return read.filter(F.col(BROKEN_LINE).isNull()).drop("icao24", "on_ground", BROKEN_LINE)


@query
def bbox_filter(spark, folder):
    return positions.within(testbed.raw_positions(spark, folder)).drop("icao24")


@query
def retention(spark, folder):
    return loading.expired_days(testbed.silver(spark, folder), "flight_date", RETENTION_RUN)


@query
def retention_kept(spark, folder):
    """Flights of a day or of none, after retention."""
    silver = testbed.silver(spark, folder)
    day = F.when(F.col("flight_number").endswith("-1"), F.col("flight_date"))
    kept = loading.retained(silver.withColumn("flight_date", day), "flight_date", RETENTION_RUN)
    return kept.groupBy("flight_date").agg(F.count(F.lit(1)).alias("kept_rows"))


# Feed responses and positions


@query
def fr24_explode(spark, folder):
    return payloads.explode_positions(testbed.position_responses(spark, folder)).drop("icao24", "on_ground")


@query
def state_vectors(spark, folder):
    return payloads.explode_state_vectors(testbed.state_responses(spark, folder))


@query
def to_ndjson(spark, folder):
    responses = testbed.position_responses(spark, folder)
    return payloads.stamped_lines(payloads.position_records(responses)).select("value")


@query
def positions_silver(spark, folder):
    return positions.silver_positions(testbed.raw_positions(spark, folder))


@query
def positions_(spark, folder):
    return positions.fact_positions(positions.silver_positions(testbed.raw_positions(spark, folder)))


@query
def positions_stream(spark, folder):
    """Responses landed twice, loaded by the stream: every position is stored once."""
    work = work_folder(spark, "positions")
    responses = testbed.position_responses(spark, folder)
    for _ in range(2):
        landed = land_positions(responses, f"{work}/landing")
        run = stream_positions(spark, landed.path, f"{work}/facts", f"{work}/checkpoint")
        run.awaitTermination()
    return tables.read_table(spark, f"{work}/facts", FACT_POSITIONS)


@query
def positions_late_files(spark, folder):
    """Files that land later but are older than all before: ten days, and four hundred."""
    work = work_folder(spark, "late")
    responses = testbed.position_responses(spark, folder)
    part = F.pmod(F.unix_seconds("polled_at"), F.lit(3))
    for number, days in enumerate((0, 10, 400)):
        landed = land_positions(responses.filter(part == number), f"{work}/{number}")
        stores.set_age(spark, landed.path, days)
        run = stream_positions(spark, work, f"{work}-facts", f"{work}-checkpoint")
        run.awaitTermination()
    return tables.read_table(spark, f"{work}-facts", FACT_POSITIONS)


@query
def dq_rejects_positions(spark, folder):
    """Responses that are cut off or no JSON, and elements that are no objects, by reason."""
    work = work_folder(spark, "rejects")
    responses = testbed.position_responses(spark, folder)
    cut = responses.select(F.expr("left(payload, length(payload) - 1)").alias("payload"), "polled_at")
    other = responses.select(F.lit('{"data":["text",[1],{"fr24_id":"x"},null]}').alias("payload"), "polled_at")
    page = responses.select(F.lit("<html>busy</html>").alias("payload"), "polled_at")
    land_positions(responses.unionByName(cut).unionByName(other).unionByName(page), work)
    refused = tables.read_table(spark, f"{work}/{REJECTED}/fr24", REJECTED_PAYLOADS)
    return refused.groupBy("reason").agg(F.count(F.lit(1)).alias("rejects"), F.countDistinct("polled_at").alias("polls"))


# Silver and facts


@query
def silver_flights(spark, folder):
    return testbed.silver(spark, folder)


@query
def fact_flights(spark, folder):
    return flights.fact_flights(testbed.silver(spark, folder))


@query
def delay_category_gold(spark, folder):
    facts = flights.fact_flights(testbed.silver(spark, folder))
    return facts.groupBy("delay_category", "is_cancelled", "is_diverted").agg(
        F.count(F.lit(1)).alias("flights"),
        F.min("total_delay_minutes").alias("least_delay"),
        F.max("total_delay_minutes").alias("most_delay"),
    )


@query
def delay_category_dw(spark, folder):
    late = F.col("arr_delay_minutes")
    labelled = testbed.silver(spark, folder).select(
        late,
        warehouse_category(late).alias("delay_category"),
        warehouse_category(late, unknown="Unknown").alias("delay_category_split"),
    )
    return labelled.groupBy("delay_category", "delay_category_split").agg(
        F.count(F.lit(1)).alias("flights"), F.min(late).alias("least_delay"), F.max(late).alias("most_delay")
    )


@query
def surrogate_key(spark, folder):
    return flights.fact_flights(testbed.silver(spark, folder)).select(
        *flights.FLIGHT_KEY, "route_key", "flight_surrogate_key"
    )


@query
def mask_tail(spark, folder):
    return masking.masked(testbed.silver(spark, folder)).select("flight_number", "carrier_code", "tail_number")


@query
def masked_view(spark, folder):
    """What a reader without the role sees: keyed hashes, of which the role's members would see the texts."""
    name = F.col("s_name").alias("user_name")
    members = spark.read.parquet(f"{folder}/supplier.parquet").select(name, F.lit(READS_SENSITIVE).alias("role"))
    seen = masking.readable(testbed.silver(spark, folder), members, READS_SENSITIVE, key=MASK_KEY)
    return seen.select("flight_number", "carrier_code", "tail_number")


# Dimensions


@query
def dim_date(spark, folder):
    return dimensions.calendar_of(testbed.flights(spark, folder), "flight_date")


@query
def distinct_carriers(spark, folder):
    return dimensions.distinct_carriers(testbed.flights(spark, folder))


@query
def scd2_carrier(spark, folder):
    return history.merge_versions(
        testbed.supplier_carriers(spark, folder),
        testbed.supplier_carriers_later(spark, folder),
        "carrier_code",
        ["carrier_name"],
        "carrier_sk",
        testbed.RUN_DATE,
    )


@query
def scd2_late_snapshot(spark, folder):
    """A snapshot that arrives after a later one was merged takes its place in the history."""
    merged = scd2_carrier(spark, folder)
    seen = testbed.supplier_carriers_seen(spark, folder, LATE_SNAPSHOT)
    return history.splice(merged, seen, "carrier_code", ["carrier_name"], "carrier_sk", "seen", LATE_SNAPSHOT)


@query
def scd2_airport(spark, folder):
    return history.merge_versions(
        testbed.customer_airports(spark, folder),
        testbed.customer_airports_later(spark, folder),
        "airport_code",
        ["airport_name", "latitude", "longitude"],
        "airport_sk",
        testbed.RUN_DATE,
    )


@query
def role_playing_airport(spark, folder):
    routes = testbed.flights(spark, folder).select(
        "flight_date", "flight_number", "origin_airport", "dest_airport", "arr_delay_minutes"
    )
    return marts.with_airports(routes, testbed.airports(spark, folder))


@query
def fact_flights_dw(spark, folder):
    return flights.star_flights(
        testbed.silver(spark, folder),
        testbed.calendar_table(spark, folder),
        testbed.carriers(spark, folder),
        testbed.airports(spark, folder),
    )


@query
def fact_point_in_time(spark, folder):
    routes = testbed.flights(spark, folder).select("flight_date", "flight_number", "origin_airport")
    return dimensions.lookup(
        routes,
        testbed.airport_versions(spark, folder),
        "origin_airport",
        "airport_code",
        {"airport_sk": "origin_airport_sk", "airport_name": "origin_name"},
        valid_on="flight_date",
    )


@query
def fact_as_of(spark, folder):
    """The same versions as `fact_point_in_time`, by one order of facts and versions instead of a range join."""
    routes = testbed.flights(spark, folder).select("flight_date", "flight_number", "origin_airport")
    return dimensions.as_of(
        routes,
        testbed.airport_versions(spark, folder),
        "origin_airport",
        "airport_code",
        "flight_date",
        {"airport_sk": "origin_airport_sk", "airport_name": "origin_name"},
        salts=4,
    )


# Marts and reports


@query
def mart_route_daily(spark, folder):
    return marts.route_performance(testbed.flights(spark, folder), "day")


@query
def mart_route_monthly(spark, folder):
    return marts.route_performance(testbed.flights(spark, folder), "month")


@query
def mart_route_rollup(spark, folder):
    """Quantiles of months and of all time, merged from stored daily sketches; the flights are read once."""
    daily = writers.staged(sketches.daily_sketches(testbed.flights(spark, folder)), "sketches")
    return sketches.route_rollup(daily)


@query
def mart_carrier_daily(spark, folder):
    return marts.carrier_daily(testbed.flights(spark, folder), testbed.carriers(spark, folder))


@query
def mart_route_dw(spark, folder):
    parts = marts.route_parts(testbed.flights(spark, folder), by_day=False)
    return marts.route_overview(parts, testbed.airports(spark, folder))


@query
def mart_delay_analysis(spark, folder):
    return marts.delay_analysis(testbed.flights(spark, folder))


@query
def daily_stats(spark, folder):
    return marts.daily_stats(testbed.flights(spark, folder))


@query
def daily_health(spark, folder):
    """The figures of the daily health run, for every day: statistics and the three busiest carriers."""
    facts = testbed.flights(spark, folder)
    figures = health(facts, facts.filter("flight_date IS NOT NULL").select("flight_date").distinct())
    busiest = F.transform("top_carriers", lambda c: F.concat_ws(":", c["carrier_code"], c["total_flights"].cast("string")))
    return figures.withColumn("top_carriers", F.array_join(busiest, ","))


@query
def scorecards(spark, folder):
    return marts.scorecards(testbed.flights(spark, folder))


@query
def daily_trend(spark, folder):
    return marts.daily_trend(testbed.flights(spark, folder))


@query
def top_carriers(spark, folder):
    return ranking.top_carriers(testbed.flights(spark, folder))


@query
def ranked_routes(spark, folder):
    routes = writers.staged(ranking.route_delays(testbed.flights(spark, folder)), "routes")
    return ranking.rank_all(routes, "avg_arr_delay", "route_rank")


@query
def carrier_ranking(spark, folder):
    carriers = writers.staged(ranking.carrier_delays(testbed.flights(spark, folder)), "carriers")
    return ranking.rank_all(carriers, "avg_arr_delay", "carrier_rank")


@query
def worst_routes_month(spark, folder):
    return ranking.worst_routes_last_month(testbed.flights(spark, folder), REPORT_RUN, k=5)


# Incremental loads


@query
def incremental_load(spark, folder):
    facts = flights.fact_flights(testbed.silver(spark, folder))
    held = facts.filter(F.col("flight_date") < LOADED_UNTIL)
    batch = facts.filter(F.col("flight_date") >= BATCH_FROM)
    days = [BATCH_FROM + dt.timedelta(n) for n in range((BATCH_UNTIL - BATCH_FROM).days + 1)]
    fresh = loading.only_new(batch, held, "flight_surrogate_key", "flight_date", days)
    return held.unionByName(fresh).select(*flights.FLIGHT_KEY, "flight_surrogate_key", "delay_category")


@query
def incremental_load_by_filter(spark, folder):
    """The same load as `incremental_load`, which looks only for keys that a day's Bloom filter may hold."""
    facts = flights.fact_flights(testbed.silver(spark, folder))
    key, day = "flight_surrogate_key", "flight_date"
    held = writers.staged(facts.filter(F.col(day) < LOADED_UNTIL), "held")
    batch = facts.filter(F.col(day) >= BATCH_FROM)
    stored = writers.staged(filters.day_filters(held, key, day), "filters")
    marked = writers.staged(filters.may_hold(batch, stored, key, day), "marked")
    fresh = filters.only_new_by_filter(marked, held, key, day)
    return held.unionByName(fresh).select(*flights.FLIGHT_KEY, key, "delay_category")


@query
def mart_refresh(spark, folder):
    """A mart of the flights up to a day in mid-month; then the months of all later flights again."""
    facts = testbed.flights(spark, folder)
    path = work_folder(spark, "mart")
    early = facts.filter(F.col("flight_date") < REFRESHED_UNTIL)
    writers.write_by_date(marts.delay_analysis(early), path, "flight_month", ["carrier_code"])
    touched = loading.days_of(facts.filter(F.col("flight_date") >= REFRESHED_UNTIL), "flight_date", "month")
    again = marts.delay_analysis(loading.on_days(facts, touched, "flight_date", "month"))
    writers.write_by_date(again, path, "flight_month", ["carrier_code"], mode="replace_dates", rebuilt=touched)
    return tables.read_table(spark, path, DELAY_ANALYSIS)


def _warehouse(spark, name, silver):
    """A new warehouse for silver flights: its folder, and a function that makes a run over what silver holds."""
    work = work_folder(spark, name)
    warehouse.write_calendar(spark, f"{work}/dw", dt.date(1990, 1, 1), dt.date(2005, 12, 31))
    carriers = dimensions.distinct_carriers(silver).withColumn("carrier_name", F.col("carrier_code"))
    codes = silver.select(F.explode(F.array("origin_airport", "dest_airport")).alias("airport_code")).distinct()
    airports = codes.selectExpr("airport_code", "airport_code AS airport_name", "0D AS latitude", "0D AS longitude")

    def run(part, since=None):
        with writers.staging(spark) as stage:
            writers.write_by_date(stage(part, "part"), f"{work}/silver/bts", "flight_date", spread=True)
        return warehouse.refresh(spark, f"{work}/silver", f"{work}/dw", RERUN_AT, carriers, airports, since=since)

    return f"{work}/dw", run


@query
def warehouse_rerun(spark, folder):
    """The same run twice, with more silver in between: the mart holds all flights."""
    silver = writers.staged(testbed.silver(spark, folder), "silver")
    early = F.col("flight_date") < LOADED_UNTIL
    root, run = _warehouse(spark, "warehouse", silver)
    run(silver.filter(early))
    run(silver.filter(~early))
    return tables.read_table(spark, f"{root}/mart_delay_analysis", DELAY_ANALYSIS)


def _corrected(spark, folder):
    """A warehouse after late reports changed the delays of some flights that it held."""
    silver = writers.staged(testbed.silver(spark, folder), "silver")
    root, run = _warehouse(spark, "corrected", silver)
    run(silver)
    late = F.pmod(F.substring_index("flight_number", "-", 1).cast("bigint"), F.lit(50)) == 0
    days = loading.days_of(silver.filter(late), "flight_date")
    delay = F.when(late, F.col("arr_delay_minutes") + 60).otherwise(F.col("arr_delay_minutes"))
    reported = loading.on_days(silver, days, "flight_date").withColumn("arr_delay_minutes", delay)
    run(flights.stamp_silver(reported, F.lit(CORRECTED_AT)), since=CORRECTED_AT)
    return root


@query
def corrected_flights(spark, folder):
    """The facts after a correction: corrected delays once, everything else as it was."""
    facts = tables.read_table(spark, f"{_corrected(spark, folder)}/fact_flights", STAR_FLIGHTS)
    return facts.select("flight_sk", "flight_date", "carrier_code", "arr_delay_minutes", "delay_category", "is_cancelled")


@query
def corrected_marts(spark, folder):
    """The all-time mart after a correction, from what the correction added and took away."""
    return tables.read_table(spark, f"{_corrected(spark, folder)}/mart_route_performance", ROUTE_OVERVIEW)


@query
def gold_emptied_day(spark, folder):
    """All flights of one day become cancelled; rebuilding the day leaves no row of it in the mart."""
    work = work_folder(spark, "emptied")
    silver = writers.staged(testbed.silver(spark, folder), "silver")
    writers.write_by_date(silver, f"{work}/silver/bts", "flight_date", spread=True)
    run = f"{EMPTIED:%Y%m%d}"
    silver_to_gold(spark, run, f"{work}/silver", f"{work}/gold")
    day = silver.filter(F.col("flight_date") == EMPTIED).withColumn("is_cancelled", F.lit(True))
    writers.write_by_date(day, f"{work}/silver/bts", "flight_date")
    silver_to_gold(spark, run, f"{work}/silver", f"{work}/gold", only_run_date=True)
    return tables.read_table(spark, f"{work}/gold/mart_route_performance", ROUTE_PERFORMANCE)


@query
def already_loaded(spark, folder):
    source = testbed.flights(spark, folder)
    return loading.month_status(source, source.filter(F.col("flight_date") < LOADED_UNTIL))


# Quality and audit


@query
def dq_rules(spark, folder):
    return quality.check_rules(testbed.silver(spark, folder), quality.SILVER_RULES)


@query
def dq_broken_rows(spark, folder):
    broken = quality.broken_rules(testbed.silver(spark, folder), quality.SILVER_RULES)
    return broken.select("flight_number", "row_hash", F.concat_ws(",", "failed_rules").alias("failed_rules"))


@query
def dq_unique_key(spark, folder):
    return quality.duplicate_keys(testbed.silver(spark, folder), flights.FLIGHT_KEY)


@query
def dq_rejects(spark, folder):
    return quality.reject_accounts(flights.parse_flights(testbed.flight_texts(spark, folder)))


@query
def run_log(spark, folder):
    work = work_folder(spark, "run")
    parsed = flights.parse_flights(testbed.flight_texts(spark, folder))
    loaded = writers.append_table(parsed, f"{work}/staged", quality.load_measures())
    entry = audit.run_entry(
        spark,
        "20240615T060000-flights",
        dt.datetime(2024, 6, 15, 6),
        "flights",
        loaded.rows - loaded.measures["rejected"],
        loaded.measures["rejected"],
        loaded.measures["avg_delay"],
        "success",
    )
    writers.append_table(entry, f"{work}/pipeline_run_log")
    return tables.read_table(spark, f"{work}/pipeline_run_log", RUN_LOG)
