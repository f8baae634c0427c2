"""Rankings without a window over all rows."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

ROWS_PER_BAND = 500_000
STRIDE = 16


def rank_all(rows: DataFrame, measure: str, rank: str = "rank", per_band: int = ROWS_PER_BAND) -> DataFrame:
    """`rank() OVER (ORDER BY measure DESC NULLS LAST)`, computed in parallel.

    A window without partition would sort everything in one task.  Instead, rows are counted per
    distinct value, the values are cut into bands at their quantiles, and each band is ranked on its
    own, starting after the rows of all bands ahead of it.  There are as many bands as it takes for
    one to hold about `per_band` values, so a band stays the work of one task however many values
    there are.  The cut points form a tree: a value is compared with `STRIDE` of them on each level.
    Every task sees the cut points, one for `per_band` values; band totals are joined by band.  Copies
    of one value are a single row in the window, so a frequent value does not fill a band.

    `rows` is read several times, once while planning: pass a table, not a costly aggregation.
    """
    value = F.col(measure)
    bands = bands_for(rows, measure, per_band)
    tally = rows.groupBy(measure).agg(F.count(F.lit(1)).alias("_rows"))
    banded = _banded(tally, measure, bands)
    # One row with all band totals from the highest band to the lowest, as running sums, and a row per band of it.
    totals = banded.groupBy("_band").agg(F.sum("_rows").alias("_total"))
    falling = F.reverse(F.array_sort(F.collect_list(F.struct("_band", "_total"))))
    nothing = F.struct(
        F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<struct<_of: int, _ahead: bigint>>").alias("bands")
    )
    running = F.aggregate(
        falling,
        nothing,
        lambda acc, t: F.struct(
            (acc["sum"] + t["_total"]).alias("sum"),
            F.concat(acc["bands"], F.array(F.struct(t["_band"].alias("_of"), acc["sum"].alias("_ahead")))).alias("bands"),
        ),
    )
    ahead = totals.agg(running.alias("t")).select(F.inline("t.bands"))
    earlier = Window.partitionBy("_band").orderBy(value.desc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranks = banded.join(ahead, F.col("_band") == F.col("_of")).select(
        value.alias("_value"),
        (F.col("_ahead") + F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) + 1).alias(rank),
    )
    return rows.join(ranks, value.eqNullSafe(F.col("_value"))).drop("_value")


def bands_for(rows: DataFrame, measure: str, per_band: int = ROWS_PER_BAND) -> int:
    """How many bands the distinct values make, counted by a sketch."""
    return max(1, math.ceil(rows.agg(F.approx_count_distinct(measure)).first()[0] / per_band))


def _banded(tally: DataFrame, measure: str, bands: int) -> DataFrame:
    """`tally` with `_band`: the number of cut points below the value, or -1 for NULL, behind all others."""
    value = F.col(measure)
    steps = [i / bands for i in range(1, bands)]
    if not steps:
        return tally.withColumn("_band", F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0)))
    none = F.array().cast(ArrayType(tally.schema[measure].dataType))
    # The sketch's error must stay well below the width of a band.
    points = F.coalesce(F.percentile_approx(value, steps, max(10_000, 20 * bands)), none)
    # Level k holds every cut point that is the last of STRIDE**k; the top one has at most STRIDE.
    widths = [1]
    while len(steps) // widths[-1] > STRIDE:
        widths.append(widths[-1] * STRIDE)
    levels = [_every("all", width).alias(f"l{k}") for k, width in enumerate(widths)]
    cuts = tally.agg(points.alias("all")).select(F.struct(*levels))
    placed = tally.withColumn("_cuts", cuts.scalar()).withColumn("_place", F.lit(0))
    for k in reversed(range(len(widths))):
        nearby = F.slice(F.col(f"_cuts.l{k}"), F.col("_place") * STRIDE + 1, F.lit(STRIDE))
        passed = F.size(F.filter(nearby, lambda c: c < value))
        placed = placed.withColumn("_place", F.col("_place") * STRIDE + passed)
    return placed.withColumn("_band", F.when(value.isNull(), F.lit(-1)).otherwise(F.col("_place"))).drop("_cuts", "_place")


def _every(points: str, width: int) -> Column:
    return F.filter(points, lambda _, i: i % width == width - 1)


def route_delays(flights: DataFrame) -> DataFrame:
    """Routes of all time with their average arrival delay, to be ranked."""
    return flights.groupBy("origin_airport", "dest_airport").agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.avg("arr_delay_minutes").alias("avg_arr_delay"),
    )


def carrier_delays(flights: DataFrame) -> DataFrame:
    """Carriers with their average arrival delay and its causes, to be ranked."""
    return flights.groupBy("carrier_code").agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.avg("arr_delay_minutes").alias("avg_arr_delay"),
        *[F.avg(f"{c}_delay_minutes").alias(f"avg_{c}_delay") for c in ("carrier", "weather", "nas")],
    )


def top_carriers(flights: DataFrame, per_day: int = 3) -> DataFrame:
    """The busiest carriers of each day; equal volumes are ordered by code.

    The rank limit is applied before the shuffle as well (window group limit).
    """
    volume = flights.groupBy("flight_date", "carrier_code").agg(F.count(F.lit(1)).alias("total_flights"))
    busiest = Window.partitionBy("flight_date").orderBy(F.desc("total_flights"), "carrier_code")
    return volume.withColumn("position", F.row_number().over(busiest)).filter(F.col("position") <= per_day)


def worst_routes(flights: DataFrame, first: dt.date, last: dt.date, k: int = 10) -> DataFrame:
    """The `k` routes with the highest average arrival delay between two days."""
    routes = route_delays(flights.filter(F.col("flight_date").between(first, last)))
    return routes.orderBy(F.desc_nulls_last("avg_arr_delay"), "origin_airport", "dest_airport").limit(k)


def worst_routes_last_month(flights: DataFrame, run_date: dt.date, k: int = 10) -> DataFrame:
    """Which routes had the worst average arrival delay in the month before `run_date`?"""
    last = run_date.replace(day=1) - dt.timedelta(days=1)
    return worst_routes(flights, last.replace(day=1), last, k)
