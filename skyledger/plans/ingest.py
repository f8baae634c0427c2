"""Saved feed responses and monthly flight files to silver."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.operators.flights import accepted, parse_flights, rejected, stamp_silver
from skyledger.operators.loading import is_loaded
from skyledger.operators.quality import load_measures
from skyledger.plans.runs import SUCCESS, logged
from skyledger.schemas import FLIGHT_COLUMNS, REJECTED_PAYLOADS, RUN_LOG, SILVER_FLIGHTS, STAGED_FLIGHTS
from skyledger.session import work_folder
from skyledger.sources.payloads import explode_state_vectors, position_records, rejected_payloads, stamped_lines
from skyledger.sources.stores import exists, remove
from skyledger.sources.tables import read_flight_files, read_table, read_table_or_empty
from skyledger.sources.writers import Written, append_table, land_lines, replace_table, write_by_date
from skyledger.streaming.positions import OLDEST_FILE

# Folder names.
POSITIONS = "fr24"
STATES = "opensky"
FLIGHTS = "bts"
STAGED = "raw_bts_flights"
REJECTED = "rejected"

# The staging folder of one month, without the columns of its path.
_PARSED = T.StructType(STAGED_FLIGHTS.fields[:-2])


@dataclass(frozen=True)
class LoadReport:
    status: str
    rows_loaded: int = 0
    rows_rejected: int = 0
    avg_delay: float | None = None


def land_positions(responses: DataFrame, bronze: str) -> Written:
    """Position responses to NDJSON below `<bronze>/fr24/year=/month=/day=`.

    What is no response or no record goes to `<bronze>/rejected/fr24` and is counted as `rejected`.
    """
    landed = land_lines(stamped_lines(position_records(responses)), f"{bronze}/{POSITIONS}")
    return _with_rejects(landed, rejected_payloads(responses), f"{bronze}/{REJECTED}/{POSITIONS}")


def land_state_vectors(responses: DataFrame, bronze: str) -> Written:
    """State-vector responses to NDJSON below `<bronze>/opensky/year=/month=/day=`; rejects as above."""
    records = explode_state_vectors(responses, keep=["polled_at"])
    whole = F.struct(*[c for c in records.columns if c != "polled_at"])
    text = F.to_json(whole, {"ignoreNullFields": "false"})
    landed = land_lines(records.select(text.alias("value"), "polled_at"), f"{bronze}/{STATES}")
    return _with_rejects(landed, rejected_payloads(responses, "states", False), f"{bronze}/{REJECTED}/{STATES}")


def _with_rejects(landed: Written, rejects: DataFrame, path: str) -> Written:
    # Found in one pass over the responses; without any, the table gets no file.
    found = work_folder(rejects.sparkSession, "rejects")
    refused = replace_table(rejects, found).rows
    if refused:
        append_table(read_table(rejects.sparkSession, found, REJECTED_PAYLOADS), path)
    remove(rejects.sparkSession, found)
    return Written(landed.path, landed.rows, {"rejected": refused})


def stream_rejects(spark: SparkSession, bronze: str, table: str, checkpoint: str) -> int:
    """Add the rejected payloads of positions that arrived since the last run to a table; how many."""
    path = f"{bronze}/{REJECTED}/{POSITIONS}"
    if not exists(spark, path):
        return 0
    counts = []
    arriving = spark.readStream.schema(REJECTED_PAYLOADS).option("maxFileAge", OLDEST_FILE).parquet(path)
    load = lambda batch, number: counts.append(replace_table(batch, f"{table}/batch={number}").rows)
    arriving.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
    return sum(counts)


def load_month(
    spark: SparkSession,
    files: str,
    silver: str,
    year: int,
    month: int,
    ingested_at: dt.datetime,
    headers: Sequence[str] = FLIGHT_COLUMNS,
    rename: Mapping[str, str] | None = None,
) -> LoadReport:
    """Load one month of flight files into `<silver>/bts`, once.

    A month that is there already is left alone, unless it was left unfinished by a load that broke
    off; then its dates are written again.  The files are parsed once, into the staging folder of the
    month.  Rows with a cell that does not parse, or with a date outside the month, stay there with
    the names of their bad columns; all others go on to silver.  Each load leaves a row in
    `<silver>/load_log`.
    """
    target, source, log = f"{silver}/{FLIGHTS}", f"{FLIGHTS}-{year}-{month:02d}", f"{silver}/load_log"
    folder = f"{silver}/{STAGED}/year={year}/month={month:02d}"
    held = read_table_or_empty(spark, target, SILVER_FLIGHTS, f"flight_date={year}-{month:02d}-*")
    if is_loaded(held, year, month):
        finished = (F.col("source") == source) & (F.col("pipeline_status") == SUCCESS)
        begun_here = not read_table_or_empty(spark, folder, _PARSED).isEmpty()
        if not begun_here or not read_table_or_empty(spark, log, RUN_LOG).filter(finished).isEmpty():
            return LoadReport("already_loaded")
    with logged(spark, log, ingested_at, source) as figures:
        parsed = _in_month(parse_flights(read_flight_files(spark, files, headers), rename), year, month)
        staged = replace_table(parsed, folder, load_measures())
        rejects = staged.measures["rejected"]
        figures.update(rejected=rejects, avg_delay=staged.measures["avg_delay"])
        loaded = write_by_date(
            stamp_silver(accepted(read_table(spark, folder, _PARSED)), F.lit(ingested_at)),
            target,
            "flight_date",
            ["carrier_code", "origin_airport"],
            mode="replace_dates",
        )
        figures.update(loaded=loaded.rows)
    return LoadReport("success", loaded.rows, rejects, figures["avg_delay"])


def months_loaded(spark: SparkSession, silver: str, since: dt.datetime) -> list[dt.date]:
    """First days of the months that `load_month` wrote from `since` on, by its log."""
    log = read_table_or_empty(spark, f"{silver}/load_log", RUN_LOG)
    done = log.filter((F.col("pipeline_status") == SUCCESS) & (F.col("run_timestamp") >= F.lit(since)))
    names = [r["source"].removeprefix(f"{FLIGHTS}-") for r in done.select("source").distinct().collect()]
    return sorted(dt.date(int(name[:4]), int(name[5:]), 1) for name in names)


def _in_month(parsed: DataFrame, year: int, month: int) -> DataFrame:
    """Count a date outside the month as a fault: silver is written in whole dates of the month."""
    inside = (F.year("flight_date") == year) & (F.month("flight_date") == month)
    faults = F.col("rejected_columns")
    listed = F.when(F.coalesce(inside, F.lit(False)), faults).otherwise(
        F.array_union(faults, F.array(F.lit("flight_date")))
    )
    return parsed.withColumn("rejected_columns", listed)


def rejected_flights(spark: SparkSession, silver: str) -> DataFrame:
    """The rows that no load could parse, of all months."""
    return rejected(read_table_or_empty(spark, f"{silver}/{STAGED}", STAGED_FLIGHTS))
