"""Dimension tables and lookups into them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.functions.keys import date_key

# A dimension is sent to every executor only up to this many rows, and values.
BROADCAST_ROWS = 200_000
BROADCAST_VALUES = 1_000_000


def calendar(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row per day from `first` to `last`."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("full_date"))
    return describe_days(days)


def calendar_of(facts: DataFrame, day: str) -> DataFrame:
    """One row per day, over the whole years that the facts touch."""
    span = facts.agg(
        F.trunc(F.min(day), "year").alias("first"),
        F.date_sub(F.add_months(F.trunc(F.max(day), "year"), 12), 1).alias("last"),
    )
    return describe_days(span.select(F.explode(F.sequence("first", "last")).alias("full_date")))


def describe_days(days: DataFrame) -> DataFrame:
    day = F.col("full_date")
    return days.select(
        date_key(day).alias("date_sk"),
        day,
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day_of_month"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.quarter(day).alias("quarter"),
        # Spark counts Sunday as 1 and Saturday as 7.
        F.dayofweek(day).isin(1, 7).alias("is_weekend"),
    )


def distinct_carriers(flights: DataFrame) -> DataFrame:
    """Carrier codes seen in the flights; copies are dropped before the shuffle."""
    return flights.select("carrier_code").distinct()


def is_small(side: DataFrame, max_rows: int = BROADCAST_ROWS, within: DataFrame | None = None) -> bool:
    """Does a count prove `side` small?

    `within` names a table that has at least as many rows and is cheaper to count: for a plain Parquet
    table only footers are read.
    """
    rows = (side if within is None else within).count()
    return rows <= max_rows and rows * len(side.columns) <= BROADCAST_VALUES


def small_side(side: DataFrame, max_rows: int = BROADCAST_ROWS, within: DataFrame | None = None) -> DataFrame:
    """Mark `side` for broadcast if it is small.

    Otherwise it comes back unmarked: the join shuffles on its keys and adaptive execution splits
    partitions that a hot key makes too large.
    """
    return F.broadcast(side) if is_small(side, max_rows, within) else side


def lookup(
    facts: DataFrame,
    dimension: DataFrame,
    fact_key: str,
    dimension_key: str,
    take: Mapping[str, str],
    valid_on: str | None = None,
    max_rows: int = BROADCAST_ROWS,
    small: bool | None = None,
) -> DataFrame:
    """Left join that adds the dimension columns `take` (dimension name -> fact name).

    With `valid_on` the version is chosen whose `effective_from`..`effective_to` holds that date.
    The equality stays the join key and the range a residual condition, so it remains a hash or
    merge join.  Facts without a match keep NULLs.  The dimension is counted, unless the caller knows
    whether it is `small`.
    """
    columns = [F.col(dimension_key).alias("_key")]
    match = F.col(fact_key) == F.col("_key")
    if valid_on:
        columns += [F.col("effective_from").alias("_from"), F.col("effective_to").alias("_to")]
        match &= (F.col(valid_on) >= F.col("_from")) & (
            F.col("_to").isNull() | (F.col(valid_on) <= F.col("_to"))
        )
    columns += [F.col(name).alias(alias) for name, alias in take.items()]
    side = dimension.select(*columns)
    if is_small(side, max_rows) if small is None else small:
        side = F.broadcast(side)
    return facts.join(side, match, "left").drop("_key", "_from", "_to")


def as_of(
    facts: DataFrame,
    versions: DataFrame,
    fact_key: str,
    version_key: str,
    valid_on: str,
    take: Mapping[str, str],
    salts: int = 1,
) -> DataFrame:
    """`lookup` with `valid_on`, for dimensions with very many versions per key.

    A range join compares each fact with all versions of its key.  Here facts and versions are put in one
    order by key and date, and each fact takes the last version before it; so the work grows with
    facts plus versions, not with their product.  Versions of a key must not overlap; where none is
    valid, facts keep NULLs.

    So that a hot key is no single group, the order is cut by month: a version stands at the head of
    each month that it reaches into, within the months of the facts.  `salts` cuts the facts of a key
    and month further, at the price of so many copies of its versions.
    """
    names = facts.columns
    row = F.struct(*[F.col(c) for c in names])
    open_ended = F.coalesce("effective_to", F.lit(dt.date(9999, 12, 31)))
    taken = F.struct(open_ended.alias("_to"), *[F.col(c).alias(a) for c, a in take.items()])
    blank = F.lit(None).cast(versions.select(taken.alias("v")).schema["v"].dataType)

    # Without a key or a date there is no version; such facts are not sorted.
    dated = F.col(fact_key).isNotNull() & F.col(valid_on).isNotNull()
    first, last = facts.filter(dated).agg(F.min(valid_on), F.max(valid_on)).first()
    placed = facts.filter(dated).select(
        F.col(fact_key).alias("_key"),
        F.trunc(valid_on, "month").alias("_month"),
        F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int").alias("_salt"),
        F.col(valid_on).alias("_at"),
        F.lit(True).alias("_fact"),
        row.alias("_row"),
        blank.alias("_version"),
    )
    begin = F.greatest("effective_from", F.lit(first).cast("date"))
    end = F.least(open_ended, F.lit(last).cast("date"))
    months = F.sequence(F.trunc(begin, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))
    reaching = versions.filter(F.col(version_key).isNotNull() & (begin <= end)).select(
        F.col(version_key).alias("_key"),
        F.explode(months).alias("_month"),
        F.array(*[F.lit(n) for n in range(salts)]).alias("_salts"),
        F.col("effective_from").alias("_from"),
        taken.alias("_version"),
    )
    heads = reaching.select(
        "_key",
        "_month",
        F.explode("_salts").alias("_salt"),
        F.greatest("_from", "_month").alias("_at"),
        F.lit(False).alias("_fact"),
        F.lit(None).cast(placed.schema["_row"].dataType).alias("_row"),
        "_version",
    )
    # Of one date the version comes before the facts.
    order = Window.partitionBy("_key", "_month", "_salt").orderBy("_at", "_fact")
    carried = placed.unionByName(heads).withColumn("_last", F.last("_version", ignorenulls=True).over(order))
    valid = F.when(F.col("_at") <= F.col("_last._to"), F.col("_last"))
    found = carried.filter("_fact").select("_row.*", valid.alias("_valid"))
    rest = facts.filter(~dated).withColumn("_valid", blank)
    return found.unionByName(rest).select(*names, *[F.col(f"_valid.{a}").alias(a) for a in take.values()])
