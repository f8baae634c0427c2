"""UTC dates and texts of instants, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400


def utc_date(moment: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(moment) / _DAY).cast("int"))


def utc_iso(moment: Column) -> Column:
    """ISO 8601 with microseconds, such as 2024-01-31T06:00:05.123456+00:00."""
    seconds = F.unix_seconds(moment)
    of_day = F.pmod(seconds, F.lit(_DAY))
    text = F.format_string(
        "%sT%02d:%02d:%02d.%06d+00:00",
        utc_date(moment).cast("string"),
        F.floor(of_day / 3600),
        F.floor(F.pmod(of_day, F.lit(3600)) / 60),
        F.pmod(of_day, F.lit(60)),
        F.unix_micros(moment) - seconds * 1_000_000,
    )
    return F.when(moment.isNotNull(), text)
