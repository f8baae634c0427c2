import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from skyledger.schemas import SILVER_FLIGHTS  # noqa: E402
from skyledger.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8,4]",  # a failed task is tried again
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def silver_of(spark):
    """Silver flights from dicts; columns left out are NULL, flags False."""

    def build(*rows):
        blank = dict.fromkeys(SILVER_FLIGHTS.names) | {"is_cancelled": False, "is_diverted": False}
        return spark.createDataFrame(
            [tuple((blank | row)[n] for n in SILVER_FLIGHTS.names) for row in rows], SILVER_FLIGHTS
        )

    return build


@pytest.fixture
def tiny_partitions(spark):
    """Settings under which a few thousand rows count as a large, skewed shuffle; nothing is broadcast."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    before = {key: spark.conf.get(key) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)
