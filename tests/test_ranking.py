import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skyledger.operators.ranking import _banded, bands_for, rank_all, top_carriers, worst_routes


@pytest.mark.parametrize("per_band", [1, 2, 60, 10**6])
@pytest.mark.parametrize("distinct", [1, 5, 400])
def test_rank_equals_brute_force(spark, per_band, distinct):
    """Ties, NULLs, and a third of all rows on one value; with one value per band the tree has three levels."""
    rng = random.Random(distinct * 1000 + per_band)
    values = [rng.choice([None, *range(distinct)]) for _ in range(400)] + [0] * 200
    rows = [(i, None if v is None else v / 4) for i, v in enumerate(values)]
    ranked = rank_all(spark.createDataFrame(rows, "id int, v double"), "v", per_band=per_band)
    got = {r["id"]: r["rank"] for r in ranked.collect()}
    known = [v for _, v in rows if v is not None]
    expected = {i: len(known) + 1 if v is None else 1 + sum(o > v for o in known) for i, v in rows}
    assert got == expected


def test_bands_grow_with_the_values(spark):
    """A hundred times the values make a hundred times the bands, none of them large, and the ranks stay right."""
    sizes = {}
    for n in (1_000, 100_000):
        rows = spark.range(n).selectExpr("id", "cast(hash(id) as double) AS v")
        bands = bands_for(rows, "v", per_band=100)
        banded = _banded(rows.selectExpr("v", "1 AS _rows"), "v", bands)
        sizes[n] = [r["count"] for r in banded.groupBy("_band").count().collect()]
    assert 80 < len(sizes[100_000]) / len(sizes[1_000]) < 125
    assert max(sizes[100_000]) < 300
    order = Window.orderBy(F.desc("v"))
    wrong = rank_all(rows, "v", per_band=100).withColumn("want", F.rank().over(order)).filter("rank <> want")
    assert wrong.isEmpty()


def test_dates_are_ranked(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i % 7) for i in range(40)]
    ranked = rank_all(spark.createDataFrame(list(enumerate(days)), "id int, v date"), "v", per_band=2)
    assert {r["id"]: r["rank"] for r in ranked.collect()} == {i: 1 + sum(o > d for o in days) for i, d in enumerate(days)}


def test_rank_without_rows_or_values(spark):
    assert rank_all(spark.createDataFrame([], "id int, v double"), "v").count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None)], "id int, v double")
    assert [r["rank"] for r in rank_all(nulls, "v").collect()] == [1, 1]


def test_no_window_over_all_rows(spark):
    rows = spark.range(100).selectExpr("id", "cast(id % 10 as double) AS v")
    plan = rank_all(rows, "v", per_band=2)._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "Window" in line)
    assert "[_band#" in window


def test_top_carriers_breaks_ties(silver_of):
    import datetime as dt

    day = dt.date(2024, 1, 1)
    rows = [{"flight_date": day, "carrier_code": c} for c in "DDCCBBAE"]
    got = [(r["position"], r["carrier_code"], r["total_flights"]) for r in top_carriers(silver_of(*rows)).collect()]
    assert sorted(got) == [(1, "B", 2), (2, "C", 2), (3, "D", 2)]


def test_worst_routes(silver_of):
    import datetime as dt

    day = dt.date(2024, 1, 1)
    rows = [
        {"flight_date": day, "origin_airport": o, "dest_airport": "X", "arr_delay_minutes": m}
        for o, m in (("A", 5.0), ("B", 9.0), ("C", 9.0), ("D", None))
    ] + [{"flight_date": day.replace(month=2), "origin_airport": "E", "dest_airport": "X", "arr_delay_minutes": 99.0}]
    got = worst_routes(silver_of(*rows), day, day.replace(day=31), k=3).collect()
    assert [r["origin_airport"] for r in got] == ["B", "C", "A"]
