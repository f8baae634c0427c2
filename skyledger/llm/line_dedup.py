"""Incremental line deduplication that can be taken back.

An index over the lines of documents has three tables in the shared folder:

* postings: which document holds which key (the 128-bit hash of a normalised line);
* counts: per key the exact number of documents that hold it, and the smallest of them;
* filters: per shard of the keys a cuckoo filter of the keys in `counts`.

Inserting documents asks the filters first.  A key that is certainly absent is new and by-passes the
exact counts, which only the others are joined with.  Deleting documents lowers the counts, takes
keys that no document holds any more out of table and filter, and finds the next smallest document
of the others.  An index is never changed in place: each step writes a new one, so a step that broke
off leaves the one before.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from skyledger.llm.common import byte_texts, staged
from skyledger.llm.cuckoo import CuckooFilter

LEAST = 10  # code points of a key; shorter lines are left alone
KEYS_PER_SHARD = 200_000  # a shard's filter takes about 1 MB with this many
KEY = ["high", "low"]


def key_of(line: bytes) -> bytes | None:
    """The normalised line if it is long enough: blanks stripped, A-Z in lower case."""
    key = line.strip().lower()
    if len(key) < LEAST or (len(key) < 4 * LEAST and len(key.decode()) < LEAST):
        return None
    return key


def hash_of(key: bytes) -> tuple[int, int]:
    """128 bits as two signed integers."""
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def postings_of(docs: DataFrame) -> DataFrame:
    """`doc_id`, `high`, `low`: each key of a document once.  Null ids and texts have none."""

    def run(batches):
        for batch in batches:
            ids, digests = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text"))):
                keys = {key for key in map(key_of, text.split(b"\n")) if key}
                ids += [doc] * len(keys)
                digests += map(xxhash.xxh3_128_digest, keys)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["doc_id", *KEY]
            )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).na.drop()
    return source.mapInArrow(run, "doc_id bigint, high bigint, low bigint")


def _counted(postings: DataFrame) -> DataFrame:
    """Exact counts; partial ones are formed before the shuffle, so a very common line is no burden."""
    return postings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first"))


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("low", 20), F.lit(shards)).cast("int").alias("shard")


def _halves(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return rows["high"].to_numpy(np.int64), rows["low"].to_numpy(np.int64)


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame | None
    counts: DataFrame | None
    filters: DataFrame | None  # shard, content
    shards: int

    @classmethod
    def empty(cls, expected_keys: int) -> LineIndex:
        """`expected_keys` sets the number of shards; filters grow beyond it, shards do not."""
        return cls(None, None, None, max(8, -(-expected_keys // KEYS_PER_SHARD)))

    def insert(self, docs: DataFrame) -> LineIndex:
        return self.insert_postings(postings_of(docs).distinct())

    def insert_postings(self, new: DataFrame) -> LineIndex:
        """The index with more postings, each of which comes once; those it has already change nothing."""
        if self.postings is None:
            postings = staged(new, "postings")
            counts = staged(_counted(postings), "counts")
            return LineIndex(postings, counts, staged(self._filters(counts), "filters"), self.shards)
        new = staged(new.join(self.postings, ["doc_id", *KEY], "left_anti"), "postings")
        probed = staged(self._probed(_counted(new)), "probed")
        maybe = probed.filter("maybe").drop("maybe")
        before = self.counts.withColumnsRenamed({"refs": "old_refs", "first": "old_first"})
        merged = before.join(maybe, KEY, "full_outer").select(
            *KEY,
            (F.coalesce("old_refs", F.lit(0)) + F.coalesce("refs", F.lit(0))).alias("refs"),
            F.least("old_first", "first").alias("first"),
        )
        counts = staged(merged.unionByName(probed.filter("not maybe").drop("maybe")), "counts")
        # The filter may have known a key's entry from another key: what counts is the exact table.
        added = probed.filter("not maybe").select(*KEY).union(maybe.join(self.counts, KEY, "left_anti").select(*KEY))
        return LineIndex(self.postings.unionByName(new), counts, self._changed(added, counts, "add"), self.shards)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents whose `doc_id` is in `ids`; unknown ids change nothing."""
        ids = ids.select(F.col("doc_id").cast("long"))
        stay = staged(self.postings.join(ids, "doc_id", "left_anti"), "postings")
        touched = staged(self.postings.join(ids, "doc_id", "left_semi").select(*KEY).distinct(), "touched")
        recounted = _counted(stay.join(touched, KEY, "left_semi"))
        counts = staged(self.counts.join(touched, KEY, "left_anti").unionByName(recounted), "counts")
        gone = touched.join(counts, KEY, "left_anti")
        return LineIndex(stay, counts, self._changed(gone, counts, "remove"), self.shards)

    def losses(self) -> DataFrame:
        """`doc_id`, `keys` (pairs of halves): what a document loses, if it loses any."""
        common = self.counts.filter("refs > 1").select(*KEY, "first")
        lost = self.postings.join(common, KEY).filter("doc_id <> first")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("keys"))

    def _filters(self, counts: DataFrame) -> DataFrame:
        def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            high, low = _halves(rows)
            room = 2 * len(rows)
            while not (made := CuckooFilter.sized(room)).add(high, low):
                room *= 2
            return pd.DataFrame({"shard": [key[0]], "content": [made.to_bytes()]})

        sharded = counts.select(_shard(self.shards), *KEY)
        return sharded.groupBy("shard").applyInPandas(build, "shard int, content binary")

    def _probed(self, batch: DataFrame) -> DataFrame:
        """The batch's counts with `maybe`: whether the filter can not rule the key out."""

        def probe(rows: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
            maybe = np.zeros(len(rows), bool)
            if len(kept) and len(rows):
                maybe = CuckooFilter.from_bytes(kept["content"].iloc[0]).contains(*_halves(rows))
            return rows.drop(columns="shard").assign(maybe=maybe)

        sharded = batch.select(_shard(self.shards), *KEY, "refs", "first").groupBy("shard")
        kind = "high bigint, low bigint, refs bigint, first bigint, maybe boolean"
        return sharded.cogroup(self.filters.groupBy("shard")).applyInPandas(probe, kind)

    def _changed(self, keys: DataFrame, counts: DataFrame, how: str) -> DataFrame:
        """The filters after a change; those that became too small are built anew from the counts."""

        def change(rows: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return kept
            fitted = CuckooFilter.from_bytes(kept["content"].iloc[0]) if len(kept) else CuckooFilter.sized(2 * len(rows))
            fits = getattr(fitted, how)(*_halves(rows)) is not False
            return pd.DataFrame({"shard": rows["shard"].iloc[:1], "content": [fitted.to_bytes() if fits else None]})

        sharded = keys.select(_shard(self.shards), *KEY).groupBy("shard")
        changed = sharded.cogroup(self.filters.groupBy("shard")).applyInPandas(change, "shard int, content binary")
        changed = staged(changed, "filters")
        full = changed.filter("content is null").select("shard")
        if full.isEmpty():
            return changed
        keys_of = counts.select(_shard(self.shards), *KEY).join(full, "shard", "left_semi")
        return staged(changed.filter("content is not null").unionByName(self._filters(keys_of)), "filters")


def _kept(text: bytes, lost: set[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the lines of lost keys, its number of lines before, and how many went."""
    lines = text.split(b"\n")
    if not lost:
        return text, len(lines), 0
    stay = [line for line in lines if (key := key_of(line)) is None or hash_of(key) not in lost]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def _rendered(docs: DataFrame, losses: DataFrame, figures: tuple[str, ...]) -> DataFrame:
    own = "lost"
    while own in docs.columns:
        own += "_"
    lost = losses.select(F.col("doc_id").alias("holder"), F.col("keys").alias(own))
    joined = docs.join(lost, docs["doc_id"] == lost["holder"], "left")
    joined = joined.select(*[docs[c] for c in docs.columns], lost[own])
    names = [*docs.columns, *figures]
    place, width = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            texts, counts = [], []
            for text, keys in zip(byte_texts(batch.column(place)), batch.column(width).to_pylist()):
                kept, *lines = _kept(text or b"", {(k["high"], k["low"]) for k in keys or ()})
                texts.append(None if text is None else kept)
                counts.append(lines)
            columns = batch.columns[:width]
            columns[place] = pa.array(texts, pa.binary()).cast(columns[place].type)
            columns += [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(figures))]
            yield pa.RecordBatch.from_arrays(columns, names)

    extra = [StructField(name, LongType()) for name in figures]
    return joined.mapInArrow(run, StructType([*docs.schema.fields, *extra]))


def deduplicated(docs: DataFrame, losses: DataFrame) -> DataFrame:
    """`docs` with the lost lines taken out of `text`; all other columns stay, a null text stays null."""
    return _rendered(docs, losses, ())


def index_of(docs: DataFrame, batches: int = 2) -> LineIndex:
    """An index of all documents, inserted batch by batch as new documents would be."""
    postings = staged(postings_of(docs).distinct(), "all_postings")
    index = LineIndex.empty(postings.count())
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for number in range(batches):
        index = index.insert_postings(postings.filter(part == number))
    return index


def report(docs: DataFrame) -> DataFrame:
    """`doc_id`, `n_lines`, `n_dropped`, `kept_sha256` for every row of `docs`.

    A line's key is the line stripped of blanks, A-Z in lower case.  Keys of at least ten code points
    that at least two documents hold lose all their lines except in the document of the smallest id.
    Rows with the same id are one document; a row without an id keeps all its lines and is not
    counted.  A null or empty text is one empty line.  Other columns are not looked at.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kept = _rendered(source, index_of(source).losses(), ("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
