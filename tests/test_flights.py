import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from skyledger.functions.delays import WAREHOUSE_BANDS, band, warehouse_category
from skyledger.operators.dimensions import calendar
from skyledger.operators.flights import accepted, fact_flights, parse_flights, rejected, stamp_silver, star_flights
from skyledger.operators.history import first_versions
from skyledger.operators.marts import (
    carrier_daily,
    daily_stats,
    delay_analysis,
    monthly_parts,
    route_overview,
    route_parts,
    route_performance,
)
from skyledger.schemas import FACT_FLIGHTS, FLIGHT_COLUMNS, ROUTE_PERFORMANCE, SILVER_FLIGHTS, STAR_FLIGHTS

DAY = dt.date(2024, 1, 15)
ROUTE = {"flight_date": DAY, "carrier_code": "AA", "origin_airport": "JFK", "dest_airport": "LHR"}


def by_number(rows, *columns):
    return {r["flight_number"]: tuple(r[c] for c in columns) for r in rows.collect()}


@pytest.fixture
def six(silver_of):
    return silver_of(
        ROUTE | {"flight_number": "100", "dep_delay_minutes": 5.0, "arr_delay_minutes": -5.0},
        ROUTE | {"flight_number": "101", "dep_delay_minutes": 15.0, "arr_delay_minutes": 10.0},
        ROUTE | {"flight_number": "200", "carrier_code": "DL", "arr_delay_minutes": 45.0},
        ROUTE | {"flight_number": "300", "carrier_code": "UA", "arr_delay_minutes": 120.0},
        ROUTE | {"flight_number": "102", "is_cancelled": True, "cancellation_code": "A"},
        ROUTE | {"flight_number": "400", "carrier_code": "BA", "is_diverted": True},
    )


def test_gold_categories(six):
    assert by_number(fact_flights(six), "delay_category", "total_delay_minutes") == {
        "100": ("ON_TIME", -5.0),
        "101": ("MINOR_DELAY", 10.0),
        "200": ("MODERATE_DELAY", 45.0),
        "300": ("SEVERE_DELAY", 120.0),
        "102": ("CANCELLED", None),
        "400": ("DIVERTED", 0.0),
    }


def test_fact_layout(six):
    facts = fact_flights(six)
    assert facts.columns == FACT_FLIGHTS.names
    assert facts.dtypes == [(f.name, f.dataType.simpleString()) for f in FACT_FLIGHTS]


def test_category_limits_are_inclusive(silver_of):
    limits = {0.0: "ON_TIME", 0.5: "MINOR_DELAY", 15.0: "MINOR_DELAY", 15.5: "MODERATE_DELAY",
              60.0: "MODERATE_DELAY", 60.5: "SEVERE_DELAY"}
    rows = silver_of(*[ROUTE | {"flight_number": str(m), "arr_delay_minutes": m} for m in limits])
    assert by_number(fact_flights(rows), "delay_category") == {str(m): (c,) for m, c in limits.items()}


def test_null_flags_and_nan(silver_of):
    rows = silver_of(
        ROUTE | {"flight_number": "null", "is_cancelled": None, "arr_delay_minutes": 5.0},
        ROUTE | {"flight_number": "nan", "arr_delay_minutes": float("nan")},
        ROUTE | {"flight_number": "both", "is_cancelled": True, "is_diverted": True, "arr_delay_minutes": 9.0},
    )
    assert by_number(fact_flights(rows), "delay_category") == {
        "null": ("MINOR_DELAY",),
        "nan": ("SEVERE_DELAY",),
        "both": ("CANCELLED",),
    }
    mart = route_performance(rows).collect()
    # The unknown flag is left out of the mart; NaN counts as severe.
    assert [(r["total_flights"], r["severe_delay_count"]) for r in mart] == [(1, 1)]


def test_keys_skip_null_parts(silver_of):
    rows = silver_of(
        ROUTE | {"flight_number": "7"},
        {"flight_date": DAY, "carrier_code": "AA", "dest_airport": "JFK", "is_diverted": True},
    )
    whole, sparse = sorted(
        (r["route_key"], r["flight_surrogate_key"]) for r in fact_flights(rows).collect()
    )[::-1]
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    assert whole == ("JFK-LHR", md5("AA|7|2024-01-15|JFK|LHR"))
    assert sparse == ("JFK", md5("AA|2024-01-15|JFK"))


def test_warehouse_categories(spark):
    delays = [(None,), (15.0,), (15.5,), (45.0,), (46.0,), (120.0,), (121.0,)]
    rows = spark.createDataFrame(delays, "m double")
    got = rows.select(
        band(F.col("m"), WAREHOUSE_BANDS), warehouse_category(F.col("m")), warehouse_category(F.col("m"), "None")
    ).collect()
    plain = ["Severe", "On Time", "Minor", "Minor", "Moderate", "Moderate", "Severe"]
    assert [r[0] for r in got] == plain
    assert [r[1] for r in got] == plain
    assert [r[2] for r in got] == ["None", *plain[1:]]


def test_route_mart(silver_of):
    rows = silver_of(
        *[
            ROUTE | {"dep_delay_minutes": d, "arr_delay_minutes": a, "distance_miles": 3450.0}
            for d, a in ((10.0, 10.0), (20.0, 70.0), (5.0, 5.0))
        ],
        ROUTE | {"is_cancelled": True, "distance_miles": 3450.0},
        ROUTE | {"dest_airport": "ORD", "dep_delay_minutes": 0.0, "arr_delay_minutes": 0.0},
        ROUTE | {"dest_airport": "SFO", "is_cancelled": True},
    )
    mart = route_performance(rows)
    assert mart.columns == ROUTE_PERFORMANCE.names
    found = {r["dest_airport"]: r for r in mart.collect()}
    assert set(found) == {"LHR", "ORD"}  # a route with cancelled flights only has no row
    lhr = found["LHR"]
    assert (lhr["total_flights"], lhr["severe_delay_count"], lhr["on_time_rate"]) == (3, 1, 0.6667)
    assert lhr["avg_arr_delay_minutes"] == pytest.approx(85 / 3)
    assert (lhr["median_arr_delay_minutes"], lhr["p95_arr_delay_minutes"]) == (10.0, 70.0)
    assert lhr["avg_distance_miles"] == 3450.0


def test_route_mart_of_unknown_delays(silver_of):
    row = route_performance(silver_of(ROUTE | {"is_diverted": True})).collect()[0]
    assert (row["median_arr_delay_minutes"], row["avg_arr_delay_minutes"]) == (None, None)
    assert (row["severe_delay_count"], row["on_time_rate"]) == (0, 1.0)


def test_marts_without_rows(silver_of, spark):
    empty = spark.createDataFrame([], SILVER_FLIGHTS)
    assert route_performance(empty).count() == 0
    assert delay_analysis(empty).count() == 0


def test_delay_analysis_drops_groups_without_delay(silver_of):
    rows = silver_of(
        ROUTE | {"carrier_delay_minutes": 30.0, "weather_delay_minutes": 10.0},
        ROUTE | {"nas_delay_minutes": 40.0},
        ROUTE | {"carrier_code": "DL", "carrier_delay_minutes": 0.0},
        ROUTE | {"carrier_code": "UA"},
    )
    (row,) = delay_analysis(rows).collect()
    assert row["carrier_code"] == "AA" and row["flight_month"] == dt.date(2024, 1, 1)
    assert (row["total_delay_minutes"], row["weather_delay_share"], row["carrier_delay_share"]) == (80.0, 0.125, 0.375)
    assert (row["avg_carrier_delay"], row["avg_nas_delay"]) == (30.0, 40.0)


def test_daily_parts_give_the_all_time_mart(silver_of, spark):
    rows = silver_of(
        *[
            ROUTE | {"flight_date": DAY + dt.timedelta(n % 3), "arr_delay_minutes": float(n * 13 % 200)}
            for n in range(50)
        ]
    )
    airports = first_versions(
        spark.createDataFrame(
            [("JFK", "Kennedy", 40.6, -73.8), ("LHR", "Heathrow", 51.5, -0.5)],
            "airport_code string, airport_name string, latitude double, longitude double",
        ),
        "airport_code",
        ["airport_name", "latitude", "longitude"],
        "airport_sk",
        DAY,
    )
    daily = route_overview(route_parts(rows), airports).collect()
    whole = route_overview(route_parts(rows, by_day=False), airports).collect()
    assert daily == whole
    assert route_overview(monthly_parts(route_parts(rows)), airports).collect() == whole
    late = [float(n * 13 % 200) for n in range(50)]
    assert daily[0]["avg_arr_delay"] == pytest.approx(sum(late) / 50)
    assert daily[0]["pct_severe_delays"] == 100 * sum(m > 120 for m in late) / 50
    assert (daily[0]["origin_name"], daily[0]["dest_latitude"]) == ("Kennedy", 51.5)


def test_daily_stats_of_one_day(six):
    (row,) = daily_stats(six, DAY).collect()
    assert (row["total_flights"], row["cancelled_flights"]) == (6, 1)
    assert row["severe_delay_count"] == 2  # unknown delays fall into the last band
    assert daily_stats(six, DAY + dt.timedelta(1)).count() == 0


def test_parse_flights_keeps_faults(spark):
    text = ", ".join(f"{c} string" for c in FLIGHT_COLUMNS)
    good = dict.fromkeys(FLIGHT_COLUMNS) | {"flight_date": "2024-01-15", "dep_delay_minutes": "5",
                                            "is_cancelled": "false", "is_diverted": "0", "carrier_code": "AA"}
    rows = [good, good | {"dep_delay_minutes": "oops"}, good | {"flight_date": "notadate", "is_diverted": "x"}]
    raw = spark.createDataFrame([tuple(r[c] for c in FLIGHT_COLUMNS) for r in rows], text)
    parsed = parse_flights(raw.withColumnRenamed("carrier_code", "Carrier"), {"Carrier": "carrier_code"})
    silver = stamp_silver(accepted(parsed), F.lit(dt.datetime(2024, 2, 1)))
    assert silver.dtypes == [(f.name, f.dataType.simpleString()) for f in SILVER_FLIGHTS]
    (row,) = silver.collect()
    assert (row["flight_date"], row["dep_delay_minutes"], row["is_cancelled"]) == (DAY, 5.0, False)
    assert sorted(r["rejected_columns"] for r in rejected(parsed).collect()) == [
        ["dep_delay_minutes"],
        ["flight_date", "is_diverted"],
    ]


def test_flags_as_words_or_numbers(spark):
    words = {"true": True, "F": False, "1": True, "0": False, "1.00": True, "0.00": False, "maybe": None, None: None}
    text = ", ".join(f"{c} string" for c in FLIGHT_COLUMNS)
    rows = [tuple(w if c == "is_cancelled" else None for c in FLIGHT_COLUMNS) for w in words]
    parsed = parse_flights(spark.createDataFrame(rows, text)).collect()
    assert [r["is_cancelled"] for r in parsed] == list(words.values())
    assert [r["rejected_columns"] for r in parsed] == [["is_cancelled"] if w == "maybe" else [] for w in words]


def test_row_hash_tells_null_from_text(spark):
    from skyledger.functions.keys import row_hash

    rows = spark.createDataFrame([("a", None), ("a", ""), (None, "a")], "x string, y string")
    assert rows.select(row_hash("x", "y")).distinct().count() == 3


def star_inputs(spark):
    carriers = first_versions(
        spark.createDataFrame([("AA", "American")], "carrier_code string, carrier_name string"),
        "carrier_code", ["carrier_name"], "carrier_sk", dt.date(2020, 1, 1),
    )
    airports = first_versions(
        spark.createDataFrame([("JFK", "Kennedy")], "airport_code string, airport_name string"),
        "airport_code", ["airport_name"], "airport_sk", dt.date(2020, 1, 1),
    )
    return calendar(spark, dt.date(2024, 1, 1), dt.date(2024, 12, 31)), carriers, airports


def test_star_keeps_facts_without_match(six, spark, silver_of):
    rows = six.unionByName(silver_of(ROUTE | {"flight_number": "old", "flight_date": dt.date(1999, 1, 1)}))
    star = star_flights(rows, *star_inputs(spark))
    assert star.dtypes == [(f.name, f.dataType.simpleString()) for f in STAR_FLIGHTS]
    found = {r["flight_sk"]: r for r in star.collect()}
    assert len(found) == 7
    assert sum(r["date_sk"] == "20240115" for r in found.values()) == 6
    assert sum(r["carrier_sk"] is None for r in found.values()) == 3
    assert all(r["origin_airport_sk"] and r["dest_airport_sk"] is None for r in found.values())


def test_carrier_mart(six, spark):
    _, carriers, _ = star_inputs(spark)
    row = {r["carrier_code"]: r for r in carrier_daily(six, carriers).collect()}["AA"]
    assert (row["carrier_name"], row["total_flights"], row["cancelled_flights"]) == ("American", 3, 1)
    assert (row["cancellation_rate"], row["on_time_count"], row["on_time_rate"]) == (0.3333, 2, 0.6667)
    assert row["severe_delay_count"] == 1


def test_versions_with_one_name_are_merged(six, spark):
    """AA is renamed and renamed back: two versions, one name."""
    versions = spark.createDataFrame(
        [("k1", "AA", "American", False), ("k2", "AA", "American", True), ("k3", "AA", "AAL", False)],
        "carrier_sk string, carrier_code string, carrier_name string, is_current boolean",
    )
    number = F.col("flight_number")
    keyed = six.filter("carrier_code = 'AA'").withColumn(
        "carrier_sk", F.when(number == "100", "k1").when(number == "101", "k2").otherwise("k3")
    )
    rows = {r["carrier_name"]: r for r in carrier_daily(keyed, versions, "carrier_sk").collect()}
    assert {name: r["total_flights"] for name, r in rows.items()} == {"American": 2, "AAL": 1}
    assert rows["American"]["avg_arr_delay"] == 2.5 and rows["AAL"]["avg_arr_delay"] is None
