"""Delay measures and the two category rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper limit in minutes (inclusive) and label; the last label has no limit.
GOLD_BANDS = ((0.0, "ON_TIME"), (15.0, "MINOR_DELAY"), (60.0, "MODERATE_DELAY"), (None, "SEVERE_DELAY"))
WAREHOUSE_BANDS = ((15.0, "On Time"), (45.0, "Minor"), (120.0, "Moderate"), (None, "Severe"))
GOLD_CANCELLED = "CANCELLED"
GOLD_DIVERTED = "DIVERTED"
# Arrival delays above this count as severe in the route mart.
SEVERE_MINUTES = 60.0


def band(minutes: Column, bands: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the first band whose limit is not exceeded.

    NULL compares as unknown and NaN as larger than every number, so both take the last label.
    """
    *limited, (_, last) = bands
    labels = [F.when(minutes <= F.lit(limit), F.lit(label)) for limit, label in limited]
    return F.coalesce(*labels, F.lit(last))


def total_delay(arrival: Column, cancelled: Column) -> Column:
    """Arrival delay, 0.0 when unknown, NULL for a cancelled flight."""
    return F.when(~F.coalesce(cancelled, F.lit(False)), F.coalesce(arrival, F.lit(0.0)))


def gold_category(total: Column, cancelled: Column, diverted: Column) -> Column:
    """Cancelled before diverted before the delay bands; a NULL flag counts as not set."""
    return F.coalesce(
        F.when(cancelled, F.lit(GOLD_CANCELLED)),
        F.when(diverted, F.lit(GOLD_DIVERTED)),
        band(total, GOLD_BANDS),
    )


def warehouse_category(arrival: Column, unknown: str | None = None) -> Column:
    """Four bands on the arrival delay.

    A NULL delay (cancelled, diverted) falls into the last band unless `unknown` names a label.
    """
    category = band(arrival, WAREHOUSE_BANDS)
    return category if unknown is None else F.when(arrival.isNull(), F.lit(unknown)).otherwise(category)
