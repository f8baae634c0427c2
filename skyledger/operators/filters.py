"""Bloom filters per day of a table, so that a load looks only for keys that may be there.

A filter is cut into chunks of blocks: a key belongs to one block of 512 bits in one chunk, and sets six
bits of it.  A chunk is one row with its bits as an array, so a filter of any size is rows of
bounded size, and a key is looked up by one join on day and chunk.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.dimensions import small_side
from skyledger.operators.loading import days_of, only_new

BITS = 6  # that a key sets
BLOCK_WORDS = 8  # of 64 bits
BLOCKS = 512  # of a chunk
WORDS = BLOCKS * BLOCK_WORDS
# At ten bits a key and more, about one absent key in sixty seems to be there.
KEYS_PER_CHUNK = WORDS * 64 // 10


def day_filters(rows: DataFrame, key: str, day: str) -> DataFrame:
    """`day`, `chunks`, `chunk`, `words`: the filter of each day's keys, as large as its rows need.

    Bits are combined before the shuffle.  A day with very many rows has very many chunks, which are
    groups of their own.  `rows` is read twice: pass a table.
    """
    sizes = rows.groupBy(F.col(day).alias("_day")).agg(F.ceil(F.count(F.lit(1)) / KEYS_PER_CHUNK).alias("chunks"))
    # One row per day.
    keyed = rows.select(F.col(day).alias("_day0"), key).join(F.broadcast(sizes), F.col("_day0").eqNullSafe(F.col("_day")))
    chunk = _chunk(F.col(key), F.col("chunks"))
    ones = keyed.select("_day", "chunks", chunk.alias("chunk"), F.inline(F.array(*_bits(F.col(key)))))
    # Words without a bit stand there too, so that a word's place in the array is its number.
    every = F.explode(F.sequence(F.lit(0), F.lit(WORDS - 1)))
    blank = sizes.select("_day", "chunks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    blank = blank.select("*", every.alias("word"), F.lit(0).cast("bigint").alias("mask"))
    words = ones.unionByName(blank).groupBy("_day", "chunks", "chunk", "word").agg(F.bit_or("mask").alias("mask"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "mask")))
    return words.groupBy("_day", "chunks", "chunk").agg(in_order.getField("mask").alias("words")).withColumnRenamed("_day", day)


def may_hold(batch: DataFrame, filters: DataFrame, key: str, day: str, flag: str = "may_hold") -> DataFrame:
    """The batch with `flag`: false where the filtered table certainly lacks the key on that day.

    Days without a filter hold nothing.  Filters are broadcast behind a count, and shuffled by day and
    chunk otherwise.
    """
    sizes = filters.filter("chunk = 0").select(F.col(day).alias("_day"), F.col("chunks").alias("_chunks"))
    side = small_side(filters.select(F.col(day).alias("_on"), F.col("chunk").alias("_chunk"), F.col("words").alias("_words")), MOST_CHUNKS)
    sized = batch.join(F.broadcast(sizes), F.col(day).eqNullSafe(F.col("_day")), "left")
    placed = sized.withColumn("_at", _chunk(F.col(key), F.col("_chunks")))
    found = placed.join(side, F.col(day).eqNullSafe(F.col("_on")) & (F.col("_at") == F.col("_chunk")), "left")
    held = [F.get("_words", bit["word"]).bitwiseAND(bit["mask"]) != 0 for bit in _bits(F.col(key))]
    every = held[0]
    for one in held[1:]:
        every &= one
    return found.select(*batch.columns, F.coalesce(every, F.lit(False)).alias(flag))


# Chunks that are broadcast at most: 32 KB each.
MOST_CHUNKS = 1000


def only_new_by_filter(marked: DataFrame, target: DataFrame, key: str, day: str, flag: str = "may_hold") -> DataFrame:
    """`only_new` for a batch marked by `may_hold`: of the target no day is opened that has no candidate.

    `marked` is read three times: pass a table.
    """
    batch = [c for c in marked.columns if c != flag]
    absent = marked.filter(~F.col(flag)).select(*batch)
    candidates = marked.filter(flag).select(*batch)
    days: Sequence[dt.date | None] = days_of(candidates, day)
    return absent.unionByName(only_new(candidates, target, key, day, days)) if days else absent


def _chunk(key: Column, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(key), chunks)


def _bits(key: Column) -> list[Column]:
    """Word of the chunk and mask of each bit that a key sets."""
    block = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(BLOCKS)) * BLOCK_WORDS
    # Nine bits of a hash tell one bit of the block.
    choice = F.xxhash64(key, F.lit(2))
    out = []
    for number in range(BITS):
        bit = F.shiftright(choice, 9 * number).bitwiseAND(F.lit(511))
        word = (block + F.shiftright(bit, 6)).cast("int")
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))
        out.append(F.struct(word.alias("word"), mask.alias("mask")))
    return out
