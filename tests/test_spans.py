"""Sketches of delays, and versions carried forward in one order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_plans import DAY, rows_of, some_flights

from skyledger.operators import sketches
from skyledger.operators.dimensions import as_of, lookup
from skyledger.plans.sketches import refresh_sketches, rolled_up
from skyledger.schemas import SILVER_FLIGHTS, STAR_FLIGHTS
from skyledger.sources.writers import write_by_date


def many(spark, n):
    """Flights of one route with delays 0 .. n-1 in a random order over a hundred days."""
    day = F.date_add(F.lit(DAY), (F.col("id") % 100).cast("int"))
    return spark.range(n).select(
        day.alias("flight_date"), F.lit("JFK").alias("origin_airport"), F.lit("LHR").alias("dest_airport"), F.lit("AA").alias("carrier_code"),
        F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("arr_delay_minutes"),
    )


def test_merged_sketches_stay_within_the_error(spark):
    n = 200_000
    rolled = sketches.route_rollup(sketches.daily_sketches(many(spark, n)))
    whole = rolled.filter("flight_month IS NULL").first()
    assert (whole["total_flights"], whole["avg_arr_delay"]) == (n, (n - 1) / 2)
    for share, value in ((0.5, whole["median_arr_delay"]), (0.95, whole["p95_arr_delay"])):
        assert abs(value / n - share) <= sketches.RANK_ERROR
    assert rolled.count() == 1 + 5


def test_small_groups_are_exact_and_unknown_delays_have_no_quantile(spark, silver_of):
    flights = some_flights(silver_of, 0, 60).unionByName(
        silver_of({"flight_date": DAY, "carrier_code": "ZZ", "origin_airport": "A", "dest_airport": "B", "is_cancelled": True})
    )
    rolled = sketches.route_rollup(sketches.daily_sketches(flights))
    exact = flights.groupBy("carrier_code", "origin_airport", "dest_airport").agg(
        F.percentile_approx("arr_delay_minutes", [0.5, 0.95], 1_000_000).alias("q")
    )
    both = rolled.filter("flight_month IS NULL").join(exact, ["carrier_code", "origin_airport", "dest_airport"])
    for r in both.collect():
        assert [r["median_arr_delay"], r["p95_arr_delay"]] == (r["q"] or [None, None])
    assert both.filter("carrier_code = 'ZZ' AND p95_arr_delay IS NULL AND avg_arr_delay IS NULL").count() == 1
    assert sketches.route_rollup(sketches.daily_sketches(flights.limit(0))).collect() == []


def test_stored_sketches_follow_the_facts(spark, silver_of, tmp_path):
    root = str(tmp_path)
    assert rolled_up(spark, root).collect() == []

    def store(flights, **how):
        facts = flights.withColumnsRenamed({"origin_airport": "origin_airport_code", "dest_airport": "dest_airport_code"})
        blank = {n: F.lit(None).cast(STAR_FLIGHTS[n].dataType) for n in STAR_FLIGHTS.names if n not in facts.columns}
        write_by_date(facts.withColumns(blank).select(*STAR_FLIGHTS.names), f"{root}/fact_flights", "flight_date", **how)

    flights = some_flights(silver_of, 0, 60)
    store(flights)
    refresh_sketches(spark, root)
    assert rows_of(rolled_up(spark, root)) == rows_of(sketches.route_rollup(sketches.daily_sketches(flights)))
    worse = flights.filter(F.col("flight_date") == DAY).withColumn("arr_delay_minutes", F.lit(900.0))
    store(worse)
    refresh_sketches(spark, root, [DAY])
    changed = flights.filter(F.col("flight_date") != DAY).unionByName(worse)
    assert rows_of(rolled_up(spark, root)) == rows_of(sketches.route_rollup(sketches.daily_sketches(changed)))
    assert SILVER_FLIGHTS.names == flights.columns


VERSIONS = "code string, name string, effective_from date, effective_to date"


def versions_of(spark, rng, key, n):
    rows, day = [], dt.date(2000, 1, 1)
    for k in range(n):
        last = day + dt.timedelta(rng.choice([0, 1, 5, 40, 800]))
        rows.append((key, f"{key}{k}", day, None if k == n - 1 and rng.random() < 0.5 else last))
        day = last + dt.timedelta(rng.choice([1, 1, 1, 30]))
    return rows + [(key, "never", day, day - dt.timedelta(1)), (None, "nobody", dt.date(2000, 1, 1), None)]


@pytest.mark.parametrize("salts", [1, 3])
def test_as_of_is_the_range_join(spark, salts):
    rng = random.Random(salts)
    versions = [r for key in "abc" for r in versions_of(spark, rng, key, 12)]
    side = spark.createDataFrame(versions, VERSIONS)
    days = [dt.date(1999, 6, 1) + dt.timedelta(rng.randrange(6000)) for _ in range(400)]
    days += [r[2] for r in versions] + [r[3] for r in versions] + [None]
    facts = spark.createDataFrame([(rng.choice(["a", "b", "c", "none", None]), d, k % 50) for k, d in enumerate(days)], "key string, day date, name int")
    take = {"name": "found", "effective_from": "since"}
    got = as_of(facts, side, "key", "code", "day", take, salts)
    want = lookup(facts, side, "key", "code", take, valid_on="day")
    assert got.columns == want.columns and rows_of(got) == rows_of(want)
    assert as_of(facts.limit(0), side, "key", "code", "day", take).collect() == []
    assert as_of(facts, side.limit(0), "key", "code", "day", take).filter("found IS NOT NULL").count() == 0


def test_a_hot_key_with_ten_thousand_versions(spark):
    """No row is multiplied: what the window sorts is the facts, the versions, and one head per month."""
    first = dt.date(1995, 1, 1)
    day = F.date_add(F.lit(first), F.col("id").cast("int"))
    versions = spark.range(10_000).select(
        F.lit("hot").alias("code"), F.col("id").cast("string").alias("name"), day.alias("effective_from"), day.alias("effective_to")
    )
    facts = spark.range(30_000).select(
        F.lit("hot").alias("key"), F.col("id"), F.date_add(F.lit(first), (F.col("id") % 10_000).cast("int")).alias("day")
    )
    got = as_of(facts, versions, "key", "code", "day", {"name": "found"}, salts=2)
    assert got.count() == 30_000
    assert got.filter("found = cast(id % 10000 as string)").count() == 30_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 1
