"""Row rules, assertions and reject accounting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.rates import complement

# Rule name -> boolean expression per row.  A rule that yields NULL has failed.
SILVER_RULES = {
    "flight_date_present": "flight_date IS NOT NULL",
    "carrier_present": "carrier_code IS NOT NULL",
    "airports_differ": "origin_airport <> dest_airport",
    "flags_present": "is_cancelled IS NOT NULL AND is_diverted IS NOT NULL",
    "not_cancelled_and_diverted": "NOT (is_cancelled AND is_diverted)",
    "cancelled_without_arrival": "NOT is_cancelled OR arr_delay_minutes IS NULL",
    "cancelled_with_code": "is_cancelled = (cancellation_code IS NOT NULL)",
    "departure_not_before_one_hour": "dep_delay_minutes IS NULL OR dep_delay_minutes >= -60",
    "distance_positive": "distance_miles > 0",
}

# For dimensions with history.
HISTORY_RULES = {
    "validity_in_order": "effective_to IS NULL OR effective_to >= effective_from",
    "current_is_open": "is_current = (effective_to IS NULL)",
}


def _holds(expression: str) -> Column:
    return F.coalesce(F.expr(expression), F.lit(False))


def check_rules(rows: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """One row per rule with its failures and pass ratio.

    All rules share one scan and one aggregate row, which is then turned on its side.
    """
    counted = rows.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(~_holds(e)).alias(name) for name, e in rules.items()],
    )
    entries = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows_failed")) for n in rules]
    )
    return counted.select("_rows", F.inline(entries)).select(
        "rule",
        F.col("_rows").alias("rows_checked"),
        "rows_failed",
        complement(F.col("rows_failed"), F.col("_rows"), 6).alias("pass_ratio"),
    )


def broken_rules(rows: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Rows that fail at least one rule, with the names of the failed rules."""
    failed = F.array_compact(F.array(*[F.when(~_holds(e), F.lit(n)) for n, e in rules.items()]))
    return rows.withColumn("failed_rules", failed).filter(F.size("failed_rules") > 0)


def duplicate_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; the assertion holds when there are none."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


class AssertionFailed(ValueError):
    """Rows that must not exist were found."""


def require_none(violations: DataFrame, name: str, shown: int = 5) -> None:
    """Fail if the query of violating rows finds any, and name a few of them."""
    found = violations.limit(shown).collect()
    if found:
        raise AssertionFailed(f"{name}: " + "; ".join(str(row.asDict()) for row in found))


def load_measures() -> dict[str, Column]:
    """Figures of parsed flights, to be counted while they are written."""
    faulty = F.size("rejected_columns") > 0
    return {
        "rejected": F.count_if(faulty),
        "avg_delay": F.avg(F.when(~faulty, F.col("arr_delay_minutes"))),
    }


def reject_accounts(parsed: DataFrame) -> DataFrame:
    """Per month: rows read, rows rejected, and how many cells failed in all.

    A row whose date did not parse has month NULL.
    """
    faults = F.size("rejected_columns")
    return parsed.groupBy(F.trunc("flight_date", "month").alias("flight_month")).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(faults > 0).alias("rows_rejected"),
        F.sum(faults).cast("bigint").alias("cells_rejected"),
    )
