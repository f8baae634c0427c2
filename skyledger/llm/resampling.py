"""Importance resampling towards a target distribution, with hashed runs of words.

A document's features are its runs of one to `longest` words, each hashed to a bucket by the CRC-32 of its
bytes.  How much more frequent a bucket is in the target than in the corpus is its gain; a document's
weight adds up the gains of its features, and a fixed share of the documents is drawn without
replacement by adding Gumbel noise to the weights and taking the highest.

The distinct features of a batch are laid out by length, those of one length as the rows of a byte matrix,
so that a step of the CRC is one table lookup for a whole column; the buckets are scattered back to the
features from there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import byte_texts, staged
from skyledger.llm.decontamination import words_of

LONGEST = 1  # words of a feature
BUCKETS = 10_000
SCALE = 1000  # gains and noise are whole numbers of thousandths
SHARE = 10  # per cent of the documents that are drawn
LEAST_WORDS = 20  # of a document that can be drawn
SEED = 2024
ROWS_PER_TASK = 2_000_000  # of the sort
POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, crc >> np.uint32(1) ^ np.uint32(POLYNOMIAL), crc >> np.uint32(1))
    return crc


CRC = _crc_table()


def crc32(features: list[bytes]) -> np.ndarray:
    """The CRC-32 of every feature."""
    out = np.zeros(len(features), np.uint32)
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        if not len(group):
            continue
        size = int(lengths[group[0]])
        matrix = np.frombuffer(b"".join([features[i] for i in group.tolist()]), np.uint8).reshape(len(group), size)
        crc = np.full(len(group), 0xFFFFFFFF, np.uint32)
        for column in np.ascontiguousarray(matrix.T):
            crc = CRC[(crc ^ column) & np.uint32(0xFF)] ^ crc >> np.uint32(8)
        out[group] = ~crc
    return out


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _features(words: list[bytes], longest: int) -> Iterator[bytes]:
    yield from words
    for size in range(2, longest + 1):
        yield from map(b" ".join, zip(*(words[i:] for i in range(size))))


def bucketed(texts: Iterable[bytes | None], longest: int, buckets: int) -> tuple[list[int], list[np.ndarray]]:
    """Per text its words and the buckets of its features, repeats included."""
    number_of = _Numbers()
    sizes, numbered = [], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        numbered.append(np.fromiter(map(number_of.__getitem__, _features(words, longest)), np.int32))
    bucket = (crc32(list(number_of)) % np.uint32(buckets)).astype(np.int64)
    return sizes, [bucket[numbers] for numbers in numbered]


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; the driver gets one row per bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found in bucketed(byte_texts(batch.column("text")), longest, buckets)[1]:
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], ["bucket", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket bigint, n bigint")
    counts = np.zeros(buckets, np.int64)
    for row in counted.filter("n > 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-ratio of each bucket's smoothed shares of target and corpus, in thousandths, rounded down."""
    buckets = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """`doc_id`, `n_words`, `n_features`, `weight` for every row of `docs`."""

    def run(batches):
        for batch in batches:
            sizes, found = bucketed(byte_texts(batch.column("text")), longest, len(gain))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([int(gain[f].sum()) for f in found], pa.int64()),
                ],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def ranked(weighted: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """`doc_id`, `n_features`, `weight`, `score`, `rank`: the `share` per cent with the highest scores have a rank.

    `score` is the weight plus Gumbel noise from a hash of seed and id, so the draw is the same in every
    run.  Equal scores rank by id, rows without an id last; such rows share one noise.  Repeated rows are
    rows of their own with ranks one after the other.  Documents with fewer than `least_words` words
    are not drawn and do not count for the share.

    Ranks come from one sort by ranges: a row's rank is its place in its range plus the rows of the
    ranges before.  A range is cut within equal rows too, so repeated rows do not fill one.
    """
    spark = weighted.sparkSession
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = staged(
        weighted.withColumns({"score": F.col("weight") + noise, "able": F.col("n_words") >= least_words}), "scored"
    )
    rows, able = scored.agg(F.count(F.lit(1)), F.count_if("able")).first()
    drawn = share * able // 100
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("salt")]
    salted = scored.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    # The lower 33 bits of the number count the rows of a partition.
    place = F.monotonically_increasing_id()
    placed = staged(
        salted.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .select(
            "doc_id", "n_features", "weight", "score",
            F.shiftright(place, 33).alias("range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        ),
        "ranged",
    )
    sizes = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, done = [], 0
    for number in sorted(sizes):
        starts.append((number, done))
        done += sizes[number]
    # One row per range.
    before = F.broadcast(spark.createDataFrame(starts, "range bigint, start bigint"))
    rank = F.col("start") + F.col("place") + 1
    return placed.join(before, "range").select(
        "doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank")
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """`doc_id`, `n_features`, `weight`, `score`, `rank` for every row of `docs`, drawn like the texts of `target`.

    Words are runs of letters, digits and non-ASCII characters with A-Z in lower case.  A null or empty
    text has no features and weight 0.  Other columns are not looked at.  With no rows nothing is drawn.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    return ranked(weights(docs, gain, longest), share, least_words, seed)


def drawn(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of `docs`, unchanged, whose id was drawn; rows without an id are left out."""
    chosen = ranks.filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, docs["doc_id"] == F.col("_drawn"), "left_semi")
