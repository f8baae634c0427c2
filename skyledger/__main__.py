"""Command line: python -m skyledger [run_date] [silver] [gold]"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import SparkSession

from skyledger.plans.gold import parse_day, silver_to_gold
from skyledger.session import build_session


def _day(text: str) -> str:
    parse_day(text)
    return text


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="skyledger", description="Build the Gold tables from silver flights.")
    add = parser.add_argument
    add("run_date", nargs="?", type=_day, default=f"{dt.datetime.now(dt.timezone.utc):%Y%m%d}", help="YYYYMMDD, today in UTC by default")
    add("silver", nargs="?", default="silver", help="folder or URL that holds bts/")
    add("gold", nargs="?", default="gold", help="folder or URL for the Gold tables")
    add("--only-run-date", action="store_true", help="rebuild this one date")
    add("--expected-bytes", type=int, help="size of the largest shuffle, sets its partitions")
    return parser


@contextmanager
def _session(expected_bytes: int | None) -> Iterator[SparkSession]:
    spark = build_session("silver-to-gold", expected_bytes=expected_bytes)
    try:
        yield spark
    finally:
        spark.stop()


def main(arguments: Sequence[str] | None = None) -> None:
    chosen = _arguments().parse_args(arguments)
    with _session(chosen.expected_bytes) as spark:
        for table, rows in silver_to_gold(spark, chosen.run_date, chosen.silver, chosen.gold, chosen.only_run_date).items():
            print(f"{table}: {rows:,} rows")


if __name__ == "__main__":
    main()
