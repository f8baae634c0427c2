"""Views through which tables are read: what a reader sees follows from the reader's roles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from skyledger.operators.masking import SENSITIVE, readable
from skyledger.schemas import FACT_FLIGHTS, ROLE_MEMBERS, SILVER_FLIGHTS
from skyledger.sources.tables import read_table, read_table_or_empty
from skyledger.sources.writers import replace_table, staged

# The role that sees sensitive columns, and the setting that holds the secret of the masks.
READS_SENSITIVE = "sensitive_reader"
KEY_SETTING = "spark.skyledger.mask.key"
# Tables with sensitive columns: their views, folders below silver or Gold, and schemas.
SILVER_VIEWS = {"flights": ("bts", SILVER_FLIGHTS)}
GOLD_VIEWS = {"fact_flights": ("fact_flights", FACT_FLIGHTS)}


def grant(spark: SparkSession, members: str, roles: Mapping[str, Sequence[str]]) -> None:
    """Write who has which role; this replaces the table `members`.  Views follow when they are published again."""
    rows = [(user, role) for role, users in roles.items() for user in users]
    replace_table(spark.createDataFrame(rows, ROLE_MEMBERS).coalesce(1), members)


def publish(spark: SparkSession, name: str, table: DataFrame, members: str, role: str = READS_SENSITIVE) -> str:
    """Make a view `global_temp.<name>` of a table whose sensitive columns only the role's users can read.

    Other users see keyed hashes, which join and count alike.  The key comes from the configuration of
    the application and stands in no catalog; without a key nothing is published.  The view keeps a copy
    of `members` as they are now, and looks its reader up in it with each query.  It is of use where
    readers have no access to the files themselves, as with an application that serves them.
    """
    key = spark.conf.get(KEY_SETTING, "")
    if not key:
        raise ValueError(f"{KEY_SETTING} is not set")
    known = staged(read_table_or_empty(spark, members, ROLE_MEMBERS), "members")
    sensitive = [c for c in SENSITIVE if c in table.columns]
    readable(table, known, role, sensitive, key).createOrReplaceGlobalTempView(name)
    return f"global_temp.{name}"


def publish_all(spark: SparkSession, members: str, silver: str | None = None, gold: str | None = None) -> list[str]:
    """Views of all tables that have sensitive columns."""
    places = [(silver, SILVER_VIEWS), (gold, GOLD_VIEWS)]
    return [
        publish(spark, name, read_table(spark, f"{root}/{folder}", schema), members)
        for root, views in places
        if root
        for name, (folder, schema) in views.items()
    ]
