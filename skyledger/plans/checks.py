"""Quality scans of stored tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators.quality import check_rules
from skyledger.sources.writers import append_table, staged


def scan(table: DataFrame, name: str, rules: Mapping[str, str], results: str, run_at: dt.datetime) -> DataFrame:
    """Check all rules in one pass, append one row per rule to `results`, and return these rows."""
    rows = check_rules(table, rules).select(
        F.lit(run_at).alias("run_timestamp"), F.lit(name).alias("table_name"), "*"
    )
    found = staged(rows, "scan")
    append_table(found, results)
    return found
