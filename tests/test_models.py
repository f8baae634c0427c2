"""Random inputs against plain Python models of the same rules."""

import datetime as dt
import math
import statistics

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skyledger.operators.flights import fact_flights
from skyledger.operators.history import first_versions, merge_versions
from skyledger.operators.loading import only_new
from skyledger.operators.marts import route_performance
from skyledger.schemas import DIM_CARRIER, SILVER_FLIGHTS

# Each example is a Spark job.
few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

START = dt.date(2024, 1, 1)
snapshot = st.dictionaries(st.sampled_from("ABCDE"), st.sampled_from(["x", "y", None]))
snapshots = st.lists(snapshot, min_size=1, max_size=4)


def model_merge(versions, snapshot, day):
    """versions: list of [key, name, start, end]; the open one of a key is current."""
    result = [list(v) for v in versions]
    for key, name in snapshot.items():
        current = [v for v in result if v[0] == key and v[3] is None]
        if current and current[0][1] == name:
            continue
        for v in current:
            v[3] = day - dt.timedelta(1)
        result.append([key, name, day, None])
    return result


@few
@given(snapshots)
def test_history(spark, tmp_path_factory, runs):
    work = tmp_path_factory.mktemp("history")
    model = []
    dim = spark.createDataFrame([], DIM_CARRIER)
    for number, source in enumerate(runs):
        day = START + dt.timedelta(10 * number)
        rows = spark.createDataFrame(list(source.items()), "carrier_code string, carrier_name string")
        if number == 0:
            dim = first_versions(rows, "carrier_code", ["carrier_name"], "carrier_sk", day)
        else:
            dim = merge_versions(dim, rows, "carrier_code", ["carrier_name"], "carrier_sk", day)
        # Each run reads what the last one wrote.
        dim.write.parquet(f"{work}/{number}")
        dim = spark.read.schema(DIM_CARRIER).parquet(f"{work}/{number}")
        model = model_merge(model, source, day)
    got = dim.select("carrier_code", "carrier_name", "effective_from", "effective_to").collect()
    assert sorted(map(repr, (list(r) for r in got))) == sorted(map(repr, model))
    assert dim.filter("is_current <> (effective_to IS NULL)").count() == 0


flight = st.tuples(
    st.sampled_from(["AA", "BB"]),
    st.sampled_from(["JFK", "LHR", None]),
    st.one_of(st.none(), st.integers(-30, 200).map(float)),
    st.sampled_from([True, False, False, False, None]),
    st.sampled_from([True, False, False, None]),
)


def category(minutes, cancelled, diverted):
    if cancelled:
        return "CANCELLED"
    if diverted:
        return "DIVERTED"
    minutes = 0.0 if minutes is None else minutes
    for limit, label in ((0, "ON_TIME"), (15, "MINOR_DELAY"), (60, "MODERATE_DELAY")):
        if minutes <= limit:
            return label
    return "SEVERE_DELAY"


@few
@given(st.lists(flight, min_size=1, max_size=40))
def test_facts_and_route_mart(spark, rows):
    blank = dict.fromkeys(SILVER_FLIGHTS.names)
    silver = spark.createDataFrame(
        [
            tuple(
                (
                    blank
                    | {"flight_date": START, "flight_number": str(i), "carrier_code": c, "origin_airport": o,
                       "arr_delay_minutes": m, "is_cancelled": x, "is_diverted": d}
                )[n]
                for n in SILVER_FLIGHTS.names
            )
            for i, (c, o, m, x, d) in enumerate(rows)
        ],
        SILVER_FLIGHTS,
    )
    got = {int(r["flight_number"]): r["delay_category"] for r in fact_flights(silver).collect()}
    assert got == {i: category(m, x, d) for i, (_, _, m, x, d) in enumerate(rows)}

    groups = {}
    for c, o, m, x, _ in rows:
        if x is False:
            groups.setdefault((c, o), []).append(m)
    mart = {(r["carrier_code"], r["origin_airport"]): r for r in route_performance(silver).collect()}
    assert set(mart) == set(groups)
    for key, delays in groups.items():
        row, known = mart[key], sorted(m for m in delays if m is not None)
        severe = sum(m > 60 for m in known)
        assert (row["total_flights"], row["severe_delay_count"]) == (len(delays), severe)
        assert math.isclose(row["on_time_rate"], 1 - severe / len(delays), abs_tol=5.01e-5)
        if known:
            assert math.isclose(row["avg_arr_delay_minutes"], statistics.fmean(known), abs_tol=1e-9)
            rank = lambda p: known[max(math.ceil(p * len(known)), 1) - 1]
            assert (row["median_arr_delay_minutes"], row["p95_arr_delay_minutes"]) == (rank(0.5), rank(0.95))
        else:
            assert row["avg_arr_delay_minutes"] is row["median_arr_delay_minutes"] is None


keys = st.lists(st.tuples(st.sampled_from("abcdef"), st.integers(0, 3)), max_size=12)


@few
@given(keys, keys)
def test_incremental(spark, source, target):
    def table(rows):
        days = [(f"{k}{d}", START + dt.timedelta(d)) for k, d in rows]
        return spark.createDataFrame(days, "k string, day date")

    fresh = only_new(table(source), table(target), "k", "day").collect()
    assert sorted(r["k"] for r in fresh) == sorted(f"{k}{d}" for k, d in source if (k, d) not in target)
