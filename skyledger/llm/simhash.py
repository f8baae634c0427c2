"""SimHash near-duplicates by meeting in the middle.

Two fingerprints that differ in at most r bits have a word between them that differs from either in at
most r/2 bits.  So every fingerprint emits all words within r/2 bits of it, and those that share a word
are the only candidates.  For an even r all fingerprints at one word are within r bits of each other,
so linking each to one of them loses no connection; and as fingerprints are distinct, no word gets
more of them than lie within r/2 bits of it: 65 for r = 2.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import byte_texts, components, staged

SHINGLE = 3  # words
SEED = 42
BITS = 64
BLOCK = 1 << 16  # shingles of a text that are counted at a time

# Which bits a byte has, for counting bits by byte values.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
BYTE_PLACES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The fingerprint of a whole text, as a signed 64-bit integer; 0 without words.

    Words are what blanks and the control characters from tab to carriage return separate, A-Z in
    lower case; repeated shingles count each time.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    total = max(1, len(words) - size + 1)
    ones = np.zeros(BITS, np.int64)
    for done in range(0, total, BLOCK):
        n = min(BLOCK, total - done)
        hashes = np.fromiter((h for _, h in zip(range(n), map(xxhash.xxh64_intdigest, shingles, repeat(SEED)))), "<u8", n)
        values = hashes.view(np.uint8).reshape(n, 8) + BYTE_PLACES
        by_value = np.bincount(values.ravel(), minlength=2048).reshape(8, 256)
        ones += (by_value @ BYTE_BITS).ravel()
    word = np.packbits(2 * ones > total, bitorder="little").tobytes()
    return int.from_bytes(word, "little", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """`doc_id`, `bits` (the fingerprint as a long) for every row."""

    def run(batches):
        for batch in batches:
            bits = [fingerprint(text) for text in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits, pa.int64())], ["doc_id", "bits"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id bigint, bits bigint")


def ball(radius: int) -> list[int]:
    """All 64-bit words with at most so many bits, as signed integers."""
    words = [sum(1 << b for b in chosen) for n in range(radius + 1) for chosen in combinations(range(BITS), n)]
    return [w - (1 << BITS) if w >> (BITS - 1) else w for w in words]


def links(points: DataFrame, radius: int) -> DataFrame:
    """`node`, `other`: links that connect all fingerprints within `radius` bits of each other.

    `points` has distinct `bits`, each with its `node`.
    """
    if radius % 2 or not 0 <= radius <= 6:
        raise ValueError("the radius must be even, from 0 to 6")
    half = F.array(*[F.lit(w).cast("long") for w in ball(radius // 2)])
    emitted = points.select("node", "bits", F.explode(half).alias("flip")).select(
        "node", "bits", F.col("bits").bitwiseXOR(F.col("flip")).alias("word")
    )
    least = F.min(F.struct("node", "bits")).over(Window.partitionBy("word"))
    met = emitted.withColumn("least", least).filter("node <> least.node")
    near = F.bit_count(F.col("bits").bitwiseXOR(F.col("least.bits"))) <= radius
    return met.filter(near).select("node", F.col("least.node").alias("other")).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """`doc_id`, `fingerprint`, `component_id`, `kept` for every row of `docs`.

    `component_id` is the smallest doc_id that links reach; documents with one fingerprint are linked,
    texts without words (null, empty, blank) among them.  Rows with the same id count as one document.
    A row without an id gets the component of its fingerprint, null if only such rows have it, and is
    `kept` then.  Other columns are not looked at.

    Copies are reduced to their fingerprint before anything is emitted, with partial minima, and get
    their component by a join that adaptive execution may split.
    """
    printed = staged(fingerprints(docs), "fingerprints")
    points = printed.groupBy("bits").agg(F.min("doc_id").alias("node"))
    found = components(links(points.filter("node is not null"), radius), "node", "other")
    classes = points.join(found, "node", "left").select("bits", F.coalesce("component", "node").alias("component_id"))
    return printed.join(classes, "bits").select(
        "doc_id",
        F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )


def _unused(columns: list[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name


def representatives(docs: DataFrame, radius: int = 2, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs`, unchanged: one of each group of near-duplicates.

    Groups are rows whose fingerprints links connect; the ids play no part in that, so rows with one id and
    different texts are documents of their own.  Of a group the row with the smallest id stays, one without
    an id only if no other is there; of several such rows one, equal rows among them.

    The verdict is on rows: each is written with its fingerprint and a number of its own, and the numbers
    of those that go come back to it.
    """
    bits, row = _unused(docs.columns, "bits"), _unused(docs.columns, "row")
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            prints = pa.array([fingerprint(text, shingle) for text in byte_texts(batch.column(place))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*batch.schema.names, bits])

    # A schema of its own: `add` would change that of `docs`.
    schema = T.StructType([*docs.schema.fields, T.StructField(bits, T.LongType())])
    printed = staged(docs.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()), "fingerprinted")
    nameless = F.col("doc_id").isNull().alias("nameless")
    slim = printed.select(nameless, F.col("doc_id").alias("id"), F.col(bits).alias("bits"), F.col(row).alias("row"))
    points = slim.select("bits", F.col("bits").alias("node")).distinct()
    found = components(links(points, radius), "node", "other").withColumnRenamed("node", "bits")
    grouped = slim.join(found, "bits", "left").withColumn("group", F.coalesce("component", "bits"))
    # Copies are combined before the shuffle.
    first = grouped.groupBy("group").agg(F.min(F.struct("nameless", "id", "row")).alias("first"))
    gone = grouped.join(first, "group").filter("row <> first.row").select(F.col("row").alias(row))
    return printed.join(gone, row, "left_anti").select(*docs.columns)
