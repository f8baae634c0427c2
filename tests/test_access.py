import hashlib
import hmac

import pytest

from skyledger.plans import access
from skyledger.plans.access import READS_SENSITIVE, grant, publish, publish_all
from skyledger.schemas import SILVER_FLIGHTS


@pytest.fixture
def as_user(spark):
    """Run as a user; the session's own one comes back at the end."""
    current = spark._jvm.org.apache.spark.sql.catalyst.CurrentUserContext.CURRENT_USER()
    yield current.set
    current.remove()


@pytest.fixture
def keyed(spark):
    spark.conf.set(access.KEY_SETTING, "k1")
    yield
    spark.conf.unset(access.KEY_SETTING)


def seen(spark, view):
    return sorted((r[0], r[1]) for r in spark.sql(f"SELECT flight_number, tail_number FROM {view}").collect())


def hidden(text):
    return None if text is None else hmac.new(b"k1", text.encode(), hashlib.sha256).hexdigest()


def test_two_users(spark, silver_of, as_user, keyed, tmp_path):
    """One view: a member reads texts, another user hashes; grants count once the view is published again."""
    members = str(tmp_path / "members")
    grant(spark, members, {READS_SENSITIVE: ["ann"], "other": ["bob"]})
    rows = [("1", "N1"), ("2", "N1"), ("3", None), ("4", "")]
    table = silver_of(*[{"flight_number": f, "tail_number": t} for f, t in rows])
    view = publish(spark, "seen_by", table, members)
    as_user("ann")
    assert seen(spark, view) == rows
    as_user("bob")
    assert seen(spark, view) == [(f, hidden(t)) for f, t in rows]
    assert [r[0] for r in spark.sql(f"SELECT flight_number FROM {view} WHERE tail_number = 'N1'").collect()] == []
    grant(spark, members, {READS_SENSITIVE: ["bob"]})
    assert seen(spark, view) == [(f, hidden(t)) for f, t in rows]
    publish(spark, "seen_by", table, members)
    assert seen(spark, view) == rows
    as_user("ann")
    assert seen(spark, view) == [(f, hidden(t)) for f, t in rows]


def test_nobody_has_the_role(spark, silver_of, keyed, tmp_path):
    """No table of members yet: all are masked, and other columns stay as they are."""
    silver_of({"flight_number": "1", "tail_number": "N1", "carrier_code": "A"}).write.parquet(f"{tmp_path}/silver/bts")
    views = publish_all(spark, f"{tmp_path}/members", silver=f"{tmp_path}/silver")
    assert views == ["global_temp.flights"]
    assert spark.table(views[0]).columns == SILVER_FLIGHTS.names
    row = spark.table(views[0]).first()
    assert (row["tail_number"], row["carrier_code"]) == (hidden("N1"), "A")


def test_no_key_no_view(spark, silver_of, tmp_path):
    with pytest.raises(ValueError, match="is not set"):
        publish(spark, "never", silver_of({"tail_number": "N1"}), f"{tmp_path}/members")
