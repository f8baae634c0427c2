import datetime as dt

from pyspark.sql import functions as F

from skyledger.plans.health import check_day, health_log
from skyledger.schemas import STAR_FLIGHTS
from skyledger.sources.writers import write_by_date

DAY = dt.date(2024, 1, 2)
AT = dt.datetime(2024, 1, 3, 6)


def facts_of(spark, path, rows):
    """Star facts from (day, carrier, delay, cancelled)."""
    kinds = "flight_date date, carrier_code string, arr_delay_minutes double, is_cancelled boolean"
    given = spark.createDataFrame(rows, kinds)
    whole = [F.col(f.name) if f.name in given.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STAR_FLIGHTS]
    write_by_date(given.select(*whole), path, "flight_date")


def test_days_are_checked_against_those_before(spark, tmp_path):
    root = str(tmp_path)
    before = DAY - dt.timedelta(1)
    rows = [(before, "A", 1.0, False)] * 10
    rows += [(DAY, c, 10.0, False) for c in "DDCCBA"] + [(DAY, "D", None, True)] + [(None, "A", 99.0, False)]
    facts_of(spark, f"{root}/fact_flights", rows)
    first = check_day(spark, root, before, AT).first()
    assert (first["total_flights"], first["usual_flights"], first["alerts"]) == (10, None, [])
    row = check_day(spark, root, DAY, AT).first()
    assert [tuple(c) for c in row["top_carriers"]] == [("D", 3), ("C", 2), ("A", 1)]
    assert (row["total_flights"], row["cancelled_flights"], row["avg_delay_minutes"], row["usual_flights"]) == (7, 1, 10.0, 10.0)
    # A delay that is not known counts as severe by the warehouse rule.
    assert (row["severe_delay_count"], row["alerts"]) == (1, ["many_cancelled", "many_severe"])


def test_a_day_without_flights(spark, tmp_path):
    """No facts at all, then none on this day; a repeated run replaces its row."""
    root = str(tmp_path)
    for _ in range(2):
        row = check_day(spark, root, DAY, AT).first()
        assert (row["total_flights"], row["avg_delay_minutes"], row["top_carriers"], row["alerts"]) == (0, None, [], ["no_flights"])
    facts_of(spark, f"{root}/fact_flights", [(DAY - dt.timedelta(1), "A", 1.0, False)] * 4)
    check_day(spark, root, DAY - dt.timedelta(1), AT)
    assert check_day(spark, root, DAY, AT).first()["alerts"] == ["no_flights", "few_flights"]
    log = {r["flight_date"]: r["total_flights"] for r in health_log(spark, root).collect()}
    assert log == {DAY: 0, DAY - dt.timedelta(1): 4}


def test_one_folder_is_read(spark, tmp_path):
    from skyledger.plans.health import READ
    from skyledger.sources.tables import read_table

    facts_of(spark, f"{tmp_path}/fact_flights", [(DAY - dt.timedelta(n), "A", 1.0, False) for n in range(5)])
    facts = read_table(spark, f"{tmp_path}/fact_flights", STAR_FLIGHTS).select(*READ).filter(F.col("flight_date") == DAY)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(flight_date" in plan and "tail" not in plan
