"""Plans of the registered queries as they would be on large tables: nothing is small enough to broadcast."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from skyledger.catalog.registered import QUERIES
from skyledger.operators import dimensions, marts
from skyledger.session import shuffle_partitions
from skyledger.sources import testbed

FOLDER = contract.SMOKE_FOLDER

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")

# These write while they are built; their parts are covered by the others.
WRITING = {
    "scan_silver", "partition_scan", "csv_scan", "ndjson_scan", "positions_stream", "run_log", "mart_refresh",
    "warehouse_rerun", "corrected_flights", "corrected_marts", "gold_emptied_day",
}


@pytest.fixture
def large(spark, monkeypatch):
    """No broadcast by size, neither by Catalyst nor by a count."""
    monkeypatch.setattr(dimensions.is_small, "__defaults__", (0, None))
    monkeypatch.setattr(dimensions.small_side, "__defaults__", (0, None))
    monkeypatch.setattr(dimensions.lookup, "__defaults__", (None, 0, None))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def physical(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_no_unbounded_task(large, name):
    plan = physical(QUERIES[name](large, FOLDER))
    for banned in ("CartesianProduct", "NestedLoop", "BroadcastExchange", "Python", "Pandas", "MapInArrow"):
        assert banned not in plan, banned
    assert not re.search(r"Window .*windowspecdefinition\((?!\w+#)", plan)
    # A single partition only ever receives partial results of a global aggregate, or a top-k.
    lines = plan.splitlines()
    for number, line in enumerate(lines):
        if "SinglePartition" in line:
            assert re.search(r"Aggregate\(keys=\[\], .*partial_", lines[number + 1]), lines[number + 1]


def test_mart_reads_its_columns_only(large):
    plan = physical(marts.route_performance(testbed.flights(large, FOLDER)))
    scan = next(line for line in plan.splitlines() if "l_shipdate" in line and "FileScan" in line)
    assert "l_extendedprice" not in scan
    assert "Not" in scan.split("PushedFilters")[1] or "IsNotNull(l_partkey)" in scan


def test_silver_filters_reach_the_file(spark, tmp_path):
    testbed.silver(spark, FOLDER).write.parquet(f"{tmp_path}/silver")
    silver = spark.read.parquet(f"{tmp_path}/silver")
    plan = physical(marts.route_performance(silver))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "EqualTo(is_cancelled" in scan.split("PushedFilters")[1]
    read = {c.split("#")[0] for c in re.search(r"FileScan parquet \[(.*?)\]", scan)[1].split(",")}
    assert read == {
        "flight_date", "carrier_code", "origin_airport", "dest_airport",
        "dep_delay_minutes", "arr_delay_minutes", "is_cancelled", "distance_miles",
    }
    # One shuffle: partial results per task, then the groups.
    assert plan.count("Exchange hashpartitioning") == 1


def test_large_plan_gives_the_same_flights(spark, large):
    def digest(rows):
        return rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()

    shuffled = digest(testbed.silver(large, FOLDER))
    large.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    assert digest(testbed.silver(spark, FOLDER)) == shuffled


def test_shuffle_degree_follows_the_data():
    assert shuffle_partitions(10 << 30) == 200
    assert shuffle_partitions(100 << 40) == 819_200
