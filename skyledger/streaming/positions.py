"""Landed positions to the position facts, incrementally."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyledger.operators.loading import days_of, drop_copies, only_new
from skyledger.operators.positions import fact_positions, silver_positions
from skyledger.schemas import BROKEN_LINE, FACT_POSITIONS
from skyledger.sources.tables import LANDED_POSITION, read_table, read_table_or_empty
from skyledger.sources.writers import Written, replace_table, write_by_date

CLUSTER = ["icao24", "ingestion_timestamp"]
# By default a file stream skips files a week older than the newest one it has seen; backfills, copies
# that keep their times and slow uploads must not be skipped.
OLDEST_FILE = "36500d"


def load_positions(raw: DataFrame, facts_path: str) -> Written:
    """Add the positions of a batch that the fact table does not hold yet.

    The table itself is the memory of what was loaded, pruned to the batch's days, so a replayed file
    is found however old it is.  A batch that failed after writing is repeated safely.
    """
    spark = raw.sparkSession
    batch = fact_positions(silver_positions(raw))
    days = days_of(batch, "position_date")
    if not days:
        return Written(None, 0)
    target = read_table_or_empty(spark, facts_path, FACT_POSITIONS)
    fresh = only_new(drop_copies(batch, "position_sk"), target, "position_sk", "position_date", days)
    return write_by_date(fresh, facts_path, "position_date", CLUSTER, mode="append")


def stream_positions(
    spark: SparkSession,
    landing: str,
    facts_path: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    on_batch: Callable[[Written], None] = lambda _: None,
    staging: str | None = None,
    archive: str | None = None,
) -> StreamingQuery:
    """Process the files that arrived since the last run, then stop.

    A file counts as arrived whatever its time.  Its lines are parsed once, into the typed staging
    table (by default `<facts_path>_staging`, a folder per batch), and go on from there; lines that
    are no positions stay there, in the column `BROKEN_LINE`.  The checkpoint must lie on storage that
    survives the cluster.  With `archive`, files that were loaded are moved there, which keeps the
    landing folder short.  `on_batch` hears what each batch wrote, and how many lines were `rejected`.
    """
    reader = (
        spark.readStream.schema(LANDED_POSITION)
        .option("columnNameOfCorruptRecord", BROKEN_LINE)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", OLDEST_FILE)
        .option("recursiveFileLookup", True)
    )
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    arriving = reader.json(landing)
    table = staging or f"{facts_path}_staging"
    broken = F.col(BROKEN_LINE).isNotNull()

    def load(batch: DataFrame, number: int) -> None:
        # A batch that is repeated replaces its folder.
        folder = f"{table}/batch={number}"
        staged = replace_table(batch, folder, {"rejected": F.count_if(broken)})
        typed = read_table(spark, folder, LANDED_POSITION).filter(~broken).drop(BROKEN_LINE)
        done = load_positions(typed, facts_path)
        on_batch(Written(done.path, done.rows, {"rejected": staged.measures["rejected"] or 0}))

    return (
        arriving.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drop_recent_copies(arriving: DataFrame, delay: str = "2 days") -> DataFrame:
    """Streaming form of de-duplication, for sinks that cannot be searched.

    State holds the keys of the last `delay` only.  It suits feeds that repeat records shortly after;
    rows later than the watermark are left to the batch load above.
    """
    facts = fact_positions(silver_positions(arriving))
    return facts.withWatermark("ingestion_timestamp", delay).dropDuplicatesWithinWatermark(["position_sk"])
