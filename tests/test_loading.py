import contextlib
import datetime as dt
import hmac
import io
import re

import pytest
from pyspark.sql import functions as F

from skyledger.operators.loading import (
    days_of,
    drop_copies,
    expired_days,
    is_loaded,
    month_status,
    only_new,
    retained,
)
from skyledger.operators.masking import masked
from skyledger.operators.quality import (
    AssertionFailed,
    broken_rules,
    check_rules,
    duplicate_keys,
    require_none,
)
from skyledger.plans.checks import scan

JAN, FEB = dt.date(2024, 1, 10), dt.date(2024, 2, 10)


def keyed(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, day date, v int")


@pytest.mark.parametrize("days", [None, [JAN, FEB, None]], ids=["looked up", "given"])
def test_only_new(spark, days):
    target = keyed(spark, ("a", JAN, 1), ("b", FEB, 1), ("n", None, 1), ("x", dt.date(2020, 1, 1), 1))
    source = keyed(spark, ("a", JAN, 9), ("c", FEB, 3), ("c", FEB, 3), ("d", JAN, 2), ("n", None, 9), ("m", None, 4))
    got = only_new(source, target, "k", "day", days)
    assert got.columns == source.columns
    assert sorted(got.collect(), key=str) == sorted(
        [("c", FEB, 3), ("c", FEB, 3), ("d", JAN, 2), ("m", None, 4)], key=lambda r: str(keyed(spark, r).first())
    )


def test_only_new_without_days(spark):
    source = keyed(spark, ("a", None, 1), ("b", None, 2))
    target = keyed(spark, ("a", None, 1), ("c", JAN, 1))
    assert days_of(source, "day") == [None]
    for days in (None, [None]):
        assert [r["k"] for r in only_new(source, target, "k", "day", days).collect()] == ["b"]


def test_only_new_into_empty(spark):
    source = keyed(spark, ("a", JAN, 1))
    assert only_new(source, source.limit(0), "k", "day").count() == 1
    assert only_new(source.limit(0), source, "k", "day").count() == 0


def test_copies_and_anti_join_share_one_shuffle(spark, tmp_path):
    keyed(spark, ("a", JAN, 1), ("a", JAN, 1), ("b", FEB, 2)).write.parquet(f"{tmp_path}/t")
    rows = spark.read.schema("k string, day date, v int").parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = only_new(drop_copies(rows, "k"), rows.filter("v = 2"), "k", "day", [JAN, FEB])
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
        assert [tuple(r) for r in fresh.collect()] == [("a", JAN, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_target_is_pruned_by_the_batch(spark, tmp_path):
    rows = spark.range(300).selectExpr("cast(id as string) k", "date_add(date'2024-01-01', cast(id % 30 as int)) day")
    rows.write.partitionBy("day").parquet(f"{tmp_path}/t")
    target = spark.read.schema("k string, day date").parquet(f"{tmp_path}/t")
    batch = rows.filter("day = '2024-01-05'")
    fresh = only_new(batch, target, "k", "day")
    assert fresh.count() == 0
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "FileScan parquet [k#" in scan and "2024-01-05" in scan.split("PushedFilters")[0]
    # Only the folder of the batch's day is read.
    given = only_new(batch, target, "k", "day", days_of(batch, "day")).explain
    buffer = io.StringIO()
    with contextlib.redirect_stdout(buffer):
        given("formatted")
    assert re.search(r"PartitionFilters: \[.*2024-01-05.*\]", buffer.getvalue())


def test_hot_key_is_split_in_the_anti_join(spark, tiny_partitions):
    """A third of the batch is one key: its partition is cut, and all its rows survive."""
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    wide = F.sha2(F.col("id").cast("string"), 256)
    source = spark.range(90_000).repartition(12).select(hot.alias("k"), F.lit(JAN).alias("day"), wide.alias("v"))
    target = spark.range(30_000).select((F.col("id") * 3 + 1).cast("string").alias("k"), F.lit(JAN).alias("day"))
    fresh = only_new(source, target, "k", "day", [JAN])
    rows = fresh.collect()
    assert len(rows) == 60_000 and sum(r["k"] == "hot" for r in rows) == 30_000
    assert "skew=true" in fresh._jdf.queryExecution().executedPlan().toString()


def test_months(spark):
    source = keyed(spark, ("a", JAN, 1), ("b", JAN, 1), ("c", FEB, 1), ("d", dt.date(2024, 12, 31), 1))
    target = keyed(spark, ("a", JAN, 1))
    rows = month_status(source, target, "day").collect()
    got = {r["month"]: (r["source_rows"], r["loaded_rows"], r["status"]) for r in rows}
    assert got == {1: (2, 1, "already_loaded"), 2: (1, 0, "to_load"), 12: (1, 0, "to_load")}
    assert is_loaded(source, 2024, 12, "day") and not is_loaded(source, 2024, 11, "day")
    assert not is_loaded(source, 2023, 12, "day")


def test_retention(spark):
    rows = keyed(spark, ("a", JAN, 1), ("b", JAN, 1), ("c", JAN + dt.timedelta(1), 1))
    run = JAN + dt.timedelta(366)
    assert [tuple(r) for r in expired_days(rows, "day", run).collect()] == [(JAN, 2)]
    assert retained(rows, "day", run).count() == 1
    # A row without a day is not too old.
    assert retained(keyed(spark, ("n", None, 1), ("a", JAN, 1)), "day", run).collect()[0]["k"] == "n"


RULES = {"positive": "v > 0", "known": "v IS NOT NULL"}


def test_rules_fail_on_null(spark):
    rows = keyed(spark, ("a", JAN, 1), ("b", JAN, 0), ("c", JAN, None), ("d", JAN, 5))
    got = {r["rule"]: tuple(r)[1:] for r in check_rules(rows, RULES).collect()}
    assert got == {"positive": (4, 2, 0.5), "known": (4, 1, 0.75)}
    broken = {r["k"]: r["failed_rules"] for r in broken_rules(rows, RULES).collect()}
    assert broken == {"b": ["positive"], "c": ["positive", "known"]}
    empty = [tuple(r) for r in check_rules(rows.limit(0), RULES).collect()]
    assert empty == [("positive", 0, 0, None), ("known", 0, 0, None)]


def test_duplicate_keys(spark):
    rows = keyed(spark, ("a", JAN, 1), ("a", JAN, 2), ("a", FEB, 1), (None, JAN, 1), (None, JAN, 1))
    got = {(r["k"], r["copies"]) for r in duplicate_keys(rows, ["k", "day"]).collect()}
    assert got == {("a", 2), (None, 2)}


def test_required_keys(spark):
    rows = keyed(spark, ("a", JAN, 1), ("a", JAN, 2), ("b", JAN, 1))
    require_none(duplicate_keys(rows, ["k", "v"]), "unique key")
    with pytest.raises(AssertionFailed, match="unique key: {'k': 'a', 'copies': 2}"):
        require_none(duplicate_keys(rows, ["k"]), "unique key")


def test_scans_are_recorded(spark, tmp_path):
    rows = keyed(spark, ("a", JAN, 1), ("b", JAN, 0))
    at = dt.datetime(2024, 3, 1, 6)
    for number in range(2):
        found = scan(rows, "flights", RULES, str(tmp_path / "results"), at + dt.timedelta(number))
        assert {r["rule"]: r["rows_failed"] for r in found.collect()} == {"positive": 1, "known": 0}
    stored = spark.read.parquet(str(tmp_path / "results"))
    assert stored.count() == 4 and stored.select("run_timestamp").distinct().count() == 2


def test_masking(spark):
    rows = spark.createDataFrame([("N1", 1), (None, 2)], "tail_number string, n int")
    got = {r["n"]: r["tail_number"] for r in masked(rows).collect()}
    assert len(got[1]) == 64 and got[2] is None
    assert masked(rows, hide=True).columns == ["n"]


@pytest.mark.parametrize("key", ["secret", "k" * 100])
def test_keyed_masking(spark, key):
    rows = spark.createDataFrame([("N1é", 1), (None, 2)], "tail_number string, n int")
    got = {r["n"]: r["tail_number"] for r in masked(rows, key=key).collect()}
    assert got == {1: hmac.new(key.encode(), "N1é".encode(), "sha256").hexdigest(), 2: None}
