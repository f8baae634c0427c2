"""Bloom filters per day."""

import datetime as dt

from pyspark.sql import functions as F

from skyledger.operators import filters
from skyledger.operators.loading import only_new
from skyledger.sources.writers import staged, write_by_date

FIRST = dt.date(2024, 1, 1)


def keys(spark, first, last, days=3, hot=0):
    """Keys first .. last-1 on several days; `hot` more on the first day, and some without a date."""
    number = F.col("id") % (days + 1)
    day = F.when(number < days, F.date_add(F.lit(FIRST), number.cast("int")))
    rows = spark.range(first, last).select(F.concat(F.lit("k"), F.col("id")).alias("key"), day.alias("day"))
    more = spark.range(hot).select(F.concat(F.lit("hot"), F.col("id")).alias("key"), F.lit(FIRST).alias("day"))
    return rows.unionByName(more)


def test_held_keys_are_found_and_few_others(spark):
    held = staged(keys(spark, 0, 4000, hot=60_000), "held")
    built = staged(filters.day_filters(held, "key", "day"), "filters")
    chunks = {r["day"]: r["chunks"] for r in built.collect()}
    assert chunks[FIRST] == 3 and chunks[None] == 1 and built.count() == 3 + 3
    assert {r[0] for r in built.select(F.size("words")).distinct().collect()} == {filters.WORDS}
    assert filters.may_hold(held, built, "key", "day").filter("NOT may_hold").count() == 0
    absent = keys(spark, 100_000, 104_000, hot=0).unionByName(
        spark.range(20_000).select(F.concat(F.lit("cold"), F.col("id")).alias("key"), F.lit(FIRST).alias("day"))
    )
    rate = filters.may_hold(absent, built, "key", "day").filter("may_hold").count() / absent.count()
    assert rate < 0.03
    # A key counts for its day only, and a day without a filter holds nothing.
    moved = held.limit(500).withColumn("day", F.lit(dt.date(2030, 1, 1)))
    assert filters.may_hold(moved, built, "key", "day").filter("may_hold").count() == 0


def test_the_load_is_the_same_with_and_without_broadcast(spark, monkeypatch):
    held = staged(keys(spark, 0, 3000), "held")
    batch = keys(spark, 2500, 4000).withColumn("may", F.lit("x"))
    built = staged(filters.day_filters(held, "key", "day"), "filters")
    want = sorted(map(repr, only_new(batch, held, "key", "day").collect()))
    for most in (1000, 0):
        monkeypatch.setattr(filters, "MOST_CHUNKS", most)
        marked = staged(filters.may_hold(batch, built, "key", "day"), "marked")
        got = filters.only_new_by_filter(marked, held, "key", "day")
        assert got.columns == batch.columns and sorted(map(repr, got.collect())) == want and len(want) == 1000


def test_absent_keys_skip_the_table(spark, tmp_path):
    """A batch of new days opens no folder of the table; candidates open their days only."""
    write_by_date(keys(spark, 0, 2000), str(tmp_path), "day")
    held = spark.read.schema("key string, day date").parquet(str(tmp_path)).select("key", "day")
    built = staged(filters.day_filters(held, "key", "day"), "filters")
    new_days = keys(spark, 5000, 5100).withColumn("day", F.lit(dt.date(2024, 6, 1)))
    marked = staged(filters.may_hold(new_days, built, "key", "day"), "marked")
    plan = filters.only_new_by_filter(marked, held, "key", "day")._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in plan and "Join" not in plan
    known = staged(filters.may_hold(held.filter(F.col("day") == FIRST), built, "key", "day"), "marked")
    result = filters.only_new_by_filter(known, held, "key", "day")
    assert result.count() == 0
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-01" in plan.split("PartitionFilters")[-1] or "2024-01-01" in plan


def test_empty_tables(spark):
    none = keys(spark, 0, 0)
    built = filters.day_filters(none, "key", "day")
    assert built.collect() == []
    batch = keys(spark, 0, 10)
    marked = filters.may_hold(batch, built, "key", "day")
    assert filters.only_new_by_filter(marked, none, "key", "day").count() == 10
