"""Every registered query against its SQL, on the smallest test tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as contract
from skyledger.catalog.checks import CHECKS
from skyledger.catalog.registered import QUERIES

FOLDER = contract.SMOKE_FOLDER

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")

DUCK_TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(CHECKS)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, duck, name):
    sql = contract.oracle_sql()[name]
    result = contract.queries()[name](spark, FOLDER)
    types = {column: DUCK_TYPES[kind] for column, kind in result.dtypes}
    assert types == {r[0]: r[1] for r in duck.execute(f"DESCRIBE {sql}").fetchall()}
    rows, faults = compare(result, duck, sql)
    assert not faults
    assert rows > 0 or name == "dq_unique_key"
