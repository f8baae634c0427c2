"""WARC archives of pages: a deterministic sharded writer, and the reader that goes with it.

The same pages give the same files, byte for byte, on any cluster:

* Cut points of the page ids follow from the bytes per range of ids alone, so that a shard holds about
  `shard_bytes` of payload.  Each shard is one sorted stream of records, which one task writes.
* A file is closed once it has `file_bytes` of compressed records; every record is a gzip member.
* All headers and digests are made from the page and a given date, never from the clock.

Tasks write under temporary names and report what they wrote; the names of a task that was lost are in
no report.  Commit moves the reported files to their final names, which can be repeated, and writes the
manifest last.  Readers open what the manifest lists and compare digests.

Files go through pyarrow's file systems, so the folder may lie in any store that these reach, and must
be shared by all machines.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import byte_texts, staged

SHARD_BYTES = 64 << 20  # of payload
FILE_BYTES = 16 << 20  # compressed
BINS = 4096  # ranges of ids that are weighed at a time
LEAST_BINS = 16  # that a heavy range is divided into
LEVEL = 6  # of compression
DATE = "2000-01-01T00:00:00Z"  # of all records, unless given

FILE_COLUMNS = "shard bigint, number bigint, name string, records bigint, bytes bigint, sha256 string"


def base32_sha1(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    """A record as a gzip member of its own."""
    fields = [*headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {_plain(value)}\r\n" for name, value in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", level, mtime=0)


def _plain(value: str) -> str:
    """A header's value on one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def page_record(page: str, url: str | None, payload: bytes, date: str, refers: tuple[str, str | None] | None) -> bytes:
    """A response, or a revisit of the record `refers` (its name and URL) with the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", f"<urn:page:{page}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    if not refers:
        return record(headers, http + payload)
    headers += [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", f"<urn:page:{refers[0]}>"),
        ("WARC-Refers-To-Date", date),
    ]
    if refers[1] is not None:
        headers.append(("WARC-Refers-To-Target-URI", refers[1]))
    return record(headers, http)


class Roll:
    """The files of one task, one open at a time."""

    def __init__(self, folder: str, file_bytes: int, date: str):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.file_bytes, self.date = file_bytes, date
        self.shard, self.number, self.out = -1, 0, None
        self.done: list[tuple] = []

    def add(self, shard: int, content: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self._open()
        self._write(content)
        if self.size >= self.file_bytes:
            self.close()

    def _open(self) -> None:
        self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.hidden = f"{uuid.uuid4().hex}-{self.name}"
        self.out = self.store.open_output_stream(f"{self.path}/_temporary/{self.hidden}", compression=None)
        self.size, self.records, self.digest = 0, 0, hashlib.sha256()
        about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", self.date)]
        about += [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        self._write(record(about, b"format: WARC File Format 1.1\r\n"))

    def _write(self, content: bytes) -> None:
        self.out.write(content)
        self.digest.update(content)
        self.size += len(content)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.number, self.name, self.records, self.size, self.digest.hexdigest(), self.hidden))
            self.out = None
            self.number += 1


@dataclass(frozen=True)
class Archive:
    folder: str
    manifest: DataFrame


def _sums(sizes: DataFrame, lows: np.ndarray, highs: np.ndarray, widths: np.ndarray) -> DataFrame:
    """`range`, `bin`, `bytes`: the bytes in each bin of these ranges of ids."""
    shared = sizes.sparkSession.sparkContext.broadcast((lows.astype(np.int64), highs.astype(np.int64), widths))

    def run(batches):
        lows, highs, widths = shared.value
        for batch in batches:
            ids, weight = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("page_id", "bytes"))
            place = np.searchsorted(lows, ids, "right") - 1
            inside = (place >= 0) & (ids <= highs[np.maximum(place, 0)])
            ids, weight, place = ids[inside], weight[inside], place[inside]
            # Unsigned, so that ranges wider than half of all numbers divide alike.
            bins = (ids.view(np.uint64) - lows[place].view(np.uint64)) // widths[place]
            pairs, which = np.unique(np.stack([place.astype(np.uint64), bins]), axis=1, return_inverse=True)
            total = np.zeros(pairs.shape[1], np.int64)
            np.add.at(total, which.ravel(), weight)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[0].astype(np.int64)), pa.array(pairs[1].astype(np.int64)), pa.array(total)], ["range", "bin", "bytes"]
            )

    summed = sizes.mapInArrow(run, "range bigint, bin bigint, bytes bigint")
    return summed.groupBy("range", "bin").agg(F.sum("bytes").alias("bytes"))


def cut_points(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """The smallest id of each shard but the first one.

    Ranges of ids are weighed by their payload bytes; ranges that are heavier than a shard are divided
    further, all of a level by one job, so clustered ids do no harm.  There are fewer of these than
    shards; the driver gets `BINS` sums at a time, or `LEAST_BINS` for each if that is more.
    """
    known = sizes.filter("page_id is not null").select("page_id", "bytes")
    ends = known.agg(F.min("page_id"), F.max("page_id")).first()
    if ends[0] is None:
        return []
    weights: list[tuple[int, int]] = []  # first id of a range, its bytes
    todo = [(ends[0], ends[1])]
    while todo:
        bins = max(LEAST_BINS, BINS // len(todo))
        widths = [max(1, -(-(high - low + 1) // bins)) for low, high in todo]
        sums = _sums(known, *(np.array(x) for x in zip(*todo)), np.array(widths, np.uint64))
        heavy = []
        for row in sums.collect():
            (low, high), width = todo[row["range"]], widths[row["range"]]
            first = low + row["bin"] * width
            if row["bytes"] > shard_bytes and width > 1:
                heavy.append((first, min(high, first + width - 1)))
            else:
                weights.append((first, row["bytes"]))
        todo = sorted(heavy)
    cuts, filled = [], 0
    for first, weight in sorted(weights):
        if filled and filled + weight > shard_bytes:
            cuts.append(first)
            filled = 0
        filled += weight
    return cuts


def write_archive(
    pages: DataFrame,
    folder: str,
    least: int = 0,
    date: str = DATE,
    shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES,
) -> Archive:
    """Write a record per row of `page_id`, `url`, `html` to a new folder.

    Of rows with equal payloads of at least `least` bytes the one with the smallest id becomes the
    response and the others revisits of it.  Of equal rows with that id one is the response.  Null html
    is an empty payload, a null URL is left out.  Rows without an id come first; among equal payloads
    they are revisits if a row with an id has the payload, and responses otherwise.
    """
    spark = pages.sparkSession
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{path}/_temporary", recursive=True)
    source = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    source = source.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    light = staged(source.select("page_id", "url", "sha1", F.octet_length("html").cast("long").alias("bytes")), "payloads")
    cuts = np.array(cut_points(light, shard_bytes), np.int64)

    @F.pandas_udf("bigint")
    def shard(ids: pd.Series) -> pd.Series:
        there = ids.notna().to_numpy()
        known = ids.fillna(0).astype("int64").to_numpy()
        return pd.Series(np.where(there, np.searchsorted(cuts, known, "right"), 0))

    equal = light.filter(F.col("bytes") >= least).groupBy("sha1")
    named = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("owner")
    owners = equal.agg(F.count(F.lit(1)).alias("n"), named).filter("n > 1 and owner is not null")
    marks = light.filter(F.col("bytes") >= least).join(owners, "sha1").filter("page_id is null or page_id <> owner.page_id")
    marks = marks.select(
        "page_id", "sha1", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "owner"
    ).distinct()
    rows = source.select("page_id", "sha1", "url", "html", F.lit(None).cast("struct<page_id:bigint,url:string>").alias("owner"))
    placed = rows.unionByName(marks).withColumn("shard", shard("page_id"))
    placed = placed.repartitionById(len(cuts) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "sha1", F.isnull("html").desc(), "url")

    def write(batches):
        roll = Roll(folder, file_bytes, date)
        last, mark, copies = None, None, 0
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(names.index(c)).to_pylist() for c in ("shard", "page_id", "sha1", "url", "owner")]
            for number, page, sha1, url, owner, payload in zip(*columns, byte_texts(batch.column(names.index("html")))):
                if (page, sha1) != last:
                    last, mark, copies = (page, sha1), None, 0
                if payload is None:
                    mark = owner
                    continue
                refers = None
                if mark:
                    refers = (f"{mark['page_id']}:{sha1}:0", mark["url"])
                elif copies and page is not None and len(payload) >= least:
                    refers = (f"{page}:{sha1}:0", url)
                name = f"{'null' if page is None else page}:{sha1}:{copies}"
                roll.add(number, page_record(name, url, payload, date, refers))
                copies += 1
        roll.close()
        yield from pa.Table.from_pylist(
            [dict(zip(("shard", "number", "name", "records", "bytes", "sha256", "hidden"), f)) for f in roll.done],
            pa.schema([("shard", pa.int64()), ("number", pa.int64()), ("name", pa.string()), ("records", pa.int64())]
                      + [("bytes", pa.int64()), ("sha256", pa.string()), ("hidden", pa.string())]),
        ).to_batches()

    written = staged(placed.select("shard", "page_id", "sha1", "url", "html", "owner").mapInArrow(write, FILE_COLUMNS + ", hidden string"), "written")
    return Archive(folder, _commit(spark, written, folder))


def _commit(spark: SparkSession, written: DataFrame, folder: str) -> DataFrame:
    """Move the files to their final names, then write the manifest."""

    def move(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for hidden, name in zip(batch.column("hidden").to_pylist(), batch.column("name").to_pylist()):
                try:
                    store.move(f"{path}/_temporary/{hidden}", f"{path}/{name}")
                except OSError:
                    # Moved before by an attempt that was lost afterwards.
                    if store.get_file_info(f"{path}/{name}").type != fs.FileType.File:
                        raise
            yield batch.select(["shard", "number", "name", "records", "bytes", "sha256"])

    moved = written.mapInArrow(move, FILE_COLUMNS)
    moved.write.parquet(f"{folder}/manifest")
    return open_archive(spark, folder).manifest


def open_archive(spark: SparkSession, folder: str) -> Archive:
    return Archive(folder, spark.read.schema(FILE_COLUMNS).parquet(f"{folder}/manifest"))


def records_of(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed archive."""
    while line := stream.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError(f"no record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip()] = value.strip()
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
        yield headers, block


class Checked(io.RawIOBase):
    """A file that is digested while it is read."""

    def __init__(self, stream):
        self.stream, self.digest = stream, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def readinto(self, space) -> int:
        content = self.stream.read(len(space))
        self.digest.update(content)
        space[: len(content)] = content
        return len(content)


def _page_of(name: str) -> int | None:
    page = name.removeprefix("<urn:page:").split(":")[0]
    return None if page == "null" else int(page)


def read_archive(archive: Archive, payloads: bool = False) -> DataFrame:
    """A row per record: `page_id`, `url`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to`.

    With `payloads` also `payload`, null for revisits.  Files are read in parallel and record by record;
    a digest that does not fit is an error.
    """
    folder = archive.folder
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if payloads else [])]
    schema = pa.schema(list(zip(names, kinds)))

    def rows_of(headers: dict[str, str], block: bytes) -> tuple:
        head, _, payload = block.partition(b"\r\n\r\n")
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = headers["WARC-Type"] == "revisit"
        if not revisit and base32_sha1(payload) != digest:
            raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
        size = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.startswith(b"Content-Length:"))
        refers = _page_of(headers["WARC-Refers-To"]) if revisit else None
        row = (_page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"], refers)
        return row + ((None if revisit else payload,) if payloads else ())

    def read(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, sha256 in zip(batch.column("name").to_pylist(), batch.column("sha256").to_pylist()):
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    checked = Checked(stream)
                    rows = []
                    for headers, block in records_of(gzip.GzipFile(fileobj=io.BufferedReader(checked, 1 << 20))):
                        if headers["WARC-Type"] != "warcinfo":
                            rows.append(rows_of(headers, block))
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)
                    if checked.digest.hexdigest() != sha256:
                        raise ValueError(f"{name} is not the file that was written")

    types = {"page_id": "bigint", "payload_bytes": "bigint", "refers_to": "bigint", "payload": "binary"}
    files = archive.manifest.select("name", "sha256")
    # A file is the unit of work; the manifest itself is small.
    spread = files.repartition(max(1, min(files.count(), 10_000)), "name")
    return spread.mapInArrow(read, ", ".join(f"{n} {types.get(n, 'string')}" for n in names))
