"""Feed responses: one JSON document per poll."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.times import utc_iso
from skyledger.schemas import RAW_POSITION, STATE_VECTOR

# Fixed value: the field that a landed record carries its poll time in.
STAMP = "ingestion_timestamp"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Saved responses, one file each, with the time the file was stored as poll time."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.col("_metadata.file_modification_time").alias("polled_at")
    )


def _parsed(field: str, kind: str) -> Column:
    """The list in `field`, and in `broken` the payload if it is no object or the field no list."""
    return F.from_json("payload", f"{field} {kind}, broken string", {"columnNameOfCorruptRecord": "broken"})


def position_records(responses: DataFrame) -> DataFrame:
    """One row per received object, as its own JSON text, unchanged: unknown fields are kept.

    A response without objects gives no row.  What is no response or no object is left to
    `rejected_payloads`.
    """
    parsed = _parsed("data", "array<string>")
    # An inner explode would have Spark filter by the parsed list first, that is parse again for each condition.
    records = responses.select(F.explode_outer(parsed["data"]).alias("record"), "polled_at")
    return records.filter(_is_object(F.col("record")))


def rejected_payloads(responses: DataFrame, field: str = "data", objects: bool = True) -> DataFrame:
    """What can not be landed: `payload` (or the element of its list), `polled_at`, `reason`.

    `field` is the list of a response; with `objects` its elements must be objects, otherwise lists.
    An object without the field, or with null there, is an empty response and no fault.
    """
    parsed = responses.select("payload", "polled_at", _parsed(field, "array<string>").alias("p"))
    no_response = F.col("p").isNull() | F.col("p.broken").isNotNull()
    fits = _is_object if objects else _is_list

    def refused(payload: Column, reason: str) -> Column:
        return F.struct(payload.alias("payload"), F.lit(reason).alias("reason"))

    unfit = F.filter(F.col("p")[field], lambda e: ~fits(e))
    elements = F.transform(unfit, lambda e: refused(e, "no object" if objects else "no list"))
    found = F.when(no_response, F.array(refused(F.col("payload"), "no response"))).otherwise(elements)
    # In one pass that parses once, see `position_records`.
    rejects = parsed.select(F.explode_outer(found).alias("r"), "polled_at").filter(F.col("r").isNotNull())
    return rejects.select("r.payload", "polled_at", "r.reason")


def _is_object(element: Column) -> Column:
    return _starts_with(element, "{")


def _is_list(element: Column) -> Column:
    return _starts_with(element, "[")


def _starts_with(element: Column, mark: str) -> Column:
    return F.coalesce(F.startswith(F.ltrim(element), F.lit(mark)), F.lit(False))


def stamped_lines(records: DataFrame) -> DataFrame:
    """NDJSON lines: each record with the poll time as its last field, in place of one that it had."""
    record = F.col("record")
    fields = F.from_json(record, "map<string,variant>")
    others = F.map_filter(fields, lambda name, _: name != STAMP)
    # Records are passed on as they came; only one that has the field already is written anew.
    body = F.rtrim(F.when(F.contains(record, F.lit(f'"{STAMP}"')), F.to_json(others)).otherwise(record))
    inner = F.substr(body, F.lit(1), F.length(body) - 1)
    comma = F.when(F.length(F.trim(inner)) > 1, F.lit(",")).otherwise(F.lit(""))
    stamp = F.concat(F.lit(f'"{STAMP}":"'), utc_iso(F.col("polled_at")), F.lit('"}'))
    return records.select(F.concat(inner, comma, stamp).alias("value"), "polled_at")


def explode_positions(responses: DataFrame) -> DataFrame:
    """Typed raw positions, stamped with the poll time.  Fields outside the schema are left out.

    Records are parsed one by one, so that an element that is no object (see `rejected_payloads`)
    spoils no other.
    """
    record = T.StructType([f for f in RAW_POSITION if f.name != STAMP])
    return (
        position_records(responses)
        .select(F.from_json("record", record).alias("p"), "polled_at")
        .select("p.*", utc_iso(F.col("polled_at")).alias(STAMP))
    )


def explode_state_vectors(responses: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """State vectors by position: missing trailing values are NULL, surplus ones are ignored.

    Elements are parsed one by one, so that one that is no vector (see `rejected_payloads`) spoils no
    other.
    """
    elements = responses.select(F.explode(_parsed("states", "array<string>")["states"]).alias("e"), *keep)
    vectors = elements.filter(_is_list(F.col("e"))).select(F.from_json("e", "array<string>").alias("v"), *keep)
    return vectors.select(
        *[F.get("v", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(STATE_VECTOR)],
        *keep,
    )
