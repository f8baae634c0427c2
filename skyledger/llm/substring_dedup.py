"""Exact removal of repeated word windows by super-k-mer partitioning.

A window's minimiser is the m-gram of its words with the smallest hash, the leftmost of equal ones.
Consecutive windows with their minimiser at the same place make a super-k-mer: one string of words that
travels to the bucket of its minimiser.  Equal windows have equal minimisers, so all occurrences of a
window meet in one bucket, in different super-k-mers; there windows are sorted by a hash, and those
with equal hashes compared word by word.

A minimiser in very many places, as in a passage that a third of all documents hold, would make one
bucket too large.  A first pass counts minimisers; windows of the few very frequent ones are told by
128-bit BLAKE2 digests of their bytes, which go to buckets of their own, counted up by each task before.
What comes back is the windows that occur once: all others of these minimisers are repeated.  No two
different windows with one such digest are known; word hashes, which can collide, decide nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import byte_texts, staged

WINDOW = 35  # words
GRAM = 4  # words of a minimiser
FREQUENT = 2000  # places from which on a minimiser counts as frequent, at least
MOST_FREQUENT = 100_000  # minimisers can be frequent
FLUSH = 24 << 20  # bytes of super-k-mers that a task packs at a time
BUCKET = 16 << 20  # bytes of super-k-mers and digests in a bucket, on average at most
BUCKETS_PER_TASK = 4
LEVEL = 3  # of compression
PART = 1 << 22  # words of a text that are looked at together

BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)  # odd
STRINGS = [("low", "<u4"), ("doc", "<i8"), ("mark", "<i8"), ("start", "<u4"), ("bytes", "<u4")]
DIGESTS = [("a", "<u8"), ("b", "<u8"), ("n", "<i8"), ("doc", "<i8"), ("mark", "<i8"), ("start", "<u4")]
RUNS = [("doc", "<i8"), ("mark", "<i8"), ("start", "<u4"), ("n", "<u4")]
PACKED = ["bucket", "n_strings", "n_digests", "n_runs", "strings", "digests", "runs", "text"]


# All blanks as one kind.
ONE_BLANK = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
# Words are hashed as polynomials of their bytes, all of a block together; longer ones on their own.
BLOCK = 1 << 20
LONG_WORD = 1 << 12


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def canonical(text: bytes | None) -> bytes:
    """The words of a text with one blank between them."""
    even = (text or b"").translate(ONE_BLANK)
    if b"  " in even or even[:1] == b" " or even[-1:] == b" ":
        return b" ".join(even.split())
    return even


def bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a canonical text start and end."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == ord(" "))
    return np.append(0, blanks + 1), np.append(blanks, len(text))


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Of a base, and of its inverse."""
    base = int(BASES[2])
    return tuple(
        np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK - 1, b, np.uint64)]), dtype=np.uint64)
        for b in (base, pow(base, -1, 1 << 64))
    )


def hashes_of(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, which depends on its bytes only."""
    out = np.empty(len(starts), np.uint64)
    up, down = powers()
    whole = np.frombuffer(text, np.uint8)
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(starts, starts[first] + BLOCK - LONG_WORD, "left"))
        last = max(last, first + 1)
        offset = starts[first]
        sums = whole[offset : min(ends[last - 1], offset + BLOCK)].astype(np.uint64)
        sums += np.uint64(1)
        sums *= up[: len(sums)]
        np.cumsum(sums, out=sums)
        begin = starts[first:last] - offset
        end = np.minimum(ends[first:last] - offset, len(sums))
        value = sums[end - 1]
        value[begin > 0] -= sums[begin[begin > 0] - 1]
        out[first:last] = mixed(value * down[begin])
        first = last
    for word in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[word] = xxhash.xxh3_64_intdigest(text[starts[word] : ends[word]])
    return out


def spans_hash(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of every `size` consecutive hashes, which depends on nothing else."""
    out = hashes[: len(hashes) - size + 1].copy()
    for i in range(1, size):
        out = out * base + hashes[i : len(hashes) - size + 1 + i]
    return mixed(out)


def windows_hash(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """The same for long windows, by joining the hashes of halves."""
    if size <= 4:
        return spans_hash(hashes, size, base)
    half = size // 2
    part = windows_hash(hashes, half, base)
    n = len(hashes) - size + 1
    out = part[:n] * base + part[half : half + n]
    if size % 2:
        out = out * base + hashes[size - 1 : size - 1 + n]
    return mixed(out)


def super_kmers(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each super-k-mer: its minimiser, its first window, how many windows it has."""
    n = len(hashes) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none
    starts, values = [], []
    for done in range(0, n, PART):
        part = hashes[done : done + min(PART, n - done) + window - 1]
        grams = spans_hash(part, gram, BASES[0])
        bits = np.uint64(24)
        # Smaller places win among equal hashes.
        least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        span, width = window - gram + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        starts.append(first + done)
        values.append(grams[place[first]])
    start = np.concatenate(starts)
    return np.concatenate(values), start, np.diff(np.append(start, n))


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values a sorted array has."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Packer:
    """Collects what a task has for the buckets, and packs it into one row per bucket.

    Three kinds of records: super-k-mers with their strings; windows of frequent minimisers by digest,
    each once per row with its number of places and one of them; and the runs of such windows, which
    the bucket passes on.
    """

    def __init__(self, buckets: int, window: int, hot: np.ndarray):
        self.buckets, self.window, self.hot = buckets, window, hot
        self._clear()

    def _clear(self) -> None:
        self.records: dict[str, list[np.ndarray]] = {"strings": [], "digests": [], "runs": []}
        self.targets: dict[str, list[np.ndarray]] = {"strings": [], "digests": [], "runs": []}
        self.strings: list[bytes] = []
        self.size = 0

    def _put(self, kind: str, records: np.ndarray, target: np.ndarray) -> None:
        self.records[kind].append(records)
        self.targets[kind].append((target % np.uint64(self.buckets)).astype(np.int64))

    def add(self, doc: int, mark: int, text: bytes, word_starts: np.ndarray, word_ends: np.ndarray, gram: int) -> None:
        hashes = hashes_of(text, word_starts, word_ends)
        minis, starts, counts = super_kmers(hashes, self.window, gram)
        hot = among(minis, self.hot)
        if hot.any():
            self._add_windows(doc, mark, text, word_starts, word_ends, starts[hot], counts[hot])
            minis, starts, counts = minis[~hot], starts[~hot], counts[~hot]
        if not len(minis):
            return
        first, last = word_starts[starts], word_ends[starts + counts + self.window - 2]
        records = np.empty(len(minis), STRINGS)
        records["low"] = minis & np.uint64(0xFFFFFFFF)
        records["doc"], records["mark"], records["start"], records["bytes"] = doc, mark, starts, last - first
        self._put("strings", records, minis >> np.uint64(32))
        self.strings += map(text.__getitem__, map(slice, first.tolist(), last.tolist()))
        self.size += int((last - first).sum())

    def _add_windows(
        self, doc: int, mark: int, text: bytes, word_starts: np.ndarray, word_ends: np.ndarray, starts: np.ndarray, counts: np.ndarray
    ) -> None:
        runs = np.empty(len(starts), RUNS)
        runs["doc"], runs["mark"], runs["start"], runs["n"] = doc, mark, starts, counts
        # Runs may go to any bucket.
        self._put("runs", runs, mixed(starts.astype(np.uint64) ^ np.uint64(mark & (1 << 64) - 1)))
        places = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        records = np.empty(len(places), DIGESTS)
        cuts = map(slice, word_starts[places].tolist(), word_ends[places + self.window - 1].tolist())
        digests = b"".join([hashlib.blake2b(text[cut], digest_size=16).digest() for cut in cuts])
        records["a"], records["b"] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
        records["n"], records["doc"], records["mark"], records["start"] = 1, doc, mark, places
        self._put("digests", records, records["a"] >> np.uint64(32))
        self.size += records.nbytes

    def packed(self) -> pa.RecordBatch:
        """The rows of all buckets that there is something for."""
        cells: dict[str, dict[int, bytes]] = {"strings": {}, "digests": {}, "runs": {}, "text": {}}
        counts: dict[str, dict[int, int]] = {"strings": {}, "digests": {}, "runs": {}}
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for kind in counts:
            if not self.records[kind]:
                continue
            records, bucket = np.concatenate(self.records[kind]), np.concatenate(self.targets[kind])
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for rows in np.split(order, cuts[1:]):
                target, mine = int(bucket[rows[0]]), records[rows]
                if kind == "digests":
                    mine = combined(mine)
                if kind == "runs":
                    mine = distinct(mine)
                if kind == "strings":
                    cells["text"][target] = pack(b"".join(map(self.strings.__getitem__, rows.tolist())))
                cells[kind][target], counts[kind][target] = pack(columns_of(mine)), len(mine)
        self._clear()
        targets = sorted(set().union(*cells.values()))
        arrays = [pa.array(targets, pa.int32())]
        arrays += [pa.array([counts[k].get(t, 0) for t in targets], pa.int32()) for k in counts]
        arrays += [pa.array([cells[k].get(t) for t in targets], pa.binary()) for k in cells]
        return pa.RecordBatch.from_arrays(arrays, PACKED)


def combined(windows: np.ndarray) -> np.ndarray:
    """Windows by digest: how many places they have, and one of them."""
    order = np.lexsort((windows["b"], windows["a"]))
    ordered = windows[order]
    first = np.flatnonzero(np.append(True, (ordered["a"][1:] != ordered["a"][:-1]) | (ordered["b"][1:] != ordered["b"][:-1])))
    out = ordered[first].copy()
    out["n"] = np.add.reduceat(ordered["n"], first)
    return out


def distinct(records: np.ndarray) -> np.ndarray:
    """Each record once: copies of a row have equal ones."""
    ordered = records[np.lexsort([records[n] for n in records.dtype.names])]
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


def columns_of(records: np.ndarray) -> bytes:
    """Field by field and byte by byte, so that the zeros of small numbers lie together."""
    fields = [np.diff(records[n], prepend=records[n].dtype.type(0)) if n == "doc" else records[n] for n in records.dtype.names]
    return b"".join(np.ascontiguousarray(f).view(np.uint8).reshape(len(records), -1).T.tobytes() for f in fields)


def records_of(content: bytes | None, count: int, kind: list) -> np.ndarray:
    records, at = np.empty(count, kind), 0
    if not count:
        return records
    raw = zstandard.ZstdDecompressor().decompress(content)
    for name, form in kind:
        width = np.dtype(form).itemsize
        field = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count).T
        values = np.ascontiguousarray(field).view(form).ravel()
        records[name] = np.cumsum(values) if name == "doc" else values
        at += count * width
    return records


def repeated_in_bucket(entries: np.ndarray, text: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that occur more than once: entry, first window, count."""
    ends = np.cumsum(entries["bytes"].astype(np.int64))
    # A minimiser that comes once has no window that comes twice.
    _, which, counts = np.unique(entries["low"], return_inverse=True, return_counts=True)
    several = np.flatnonzero(counts[which] > 1)
    if not len(several):
        none = np.empty(0, np.int64)
        return none, none, none
    begin = ends - entries["bytes"]
    joined = b" ".join([text[a:b] for a, b in zip(begin[several].tolist(), ends[several].tolist())])
    word_starts, word_ends = bounds(joined)
    stream = hashes_of(joined, word_starts, word_ends)
    places = np.cumsum(entries["bytes"][several].astype(np.int64) + 1)
    sizes = np.diff(np.searchsorted(word_starts, places), prepend=0)
    begins = np.cumsum(sizes) - sizes
    every = windows_hash(stream, window, BASES[1])
    # Windows that lie in one super-k-mer.
    n_windows = sizes - window + 1
    owner = np.repeat(np.arange(len(sizes)), n_windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    values = every[begins[owner] + inside]
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    repeated = np.zeros(len(values), bool)
    # Runs of equal hashes are compared word by word.
    edges = np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))
    runs = zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())
    word = begins[owner] + inside
    cut = list(zip(word_starts[word].tolist(), word_ends[word + window - 1].tolist()))

    def window_text(k: int) -> bytes:
        return joined[slice(*cut[k])]

    for first, last in runs:
        members = order[first : last + 1].tolist()
        texts_of = [window_text(k) for k in members]
        if texts_of.count(texts_of[0]) == len(texts_of):
            repeated[members] = True
        else:
            seen: dict[bytes, list[int]] = {}
            for k, t in zip(members, texts_of):
                seen.setdefault(t, []).append(k)
            for group in seen.values():
                repeated[group] = len(group) > 1
    hit = np.flatnonzero(repeated)
    new = np.append(True, (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)) if len(hit) else np.empty(0, bool)
    starts = hit[new]
    counts = np.diff(np.append(np.flatnonzero(new), len(hit)))
    return several[owner[starts]], inside[starts], counts


def _rows(docs: DataFrame) -> DataFrame:
    """Texts with a mark that tells texts of one id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("mark"))


def _each(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int | None, int, bytes, np.ndarray, np.ndarray]]:
    """The texts that have a window, with the bounds of their words."""
    for doc, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), byte_texts(batch.column("text"))):
        even = canonical(text)
        starts, ends = bounds(even)
        if len(starts) >= window:
            yield doc, mark, even, starts, ends


def _frequent(rows: DataFrame, window: int, gram: int, least: int) -> tuple[np.ndarray, int]:
    """The minimisers of more than `least` places, or of more than their share if that is more; sorted.

    There are no more than `MOST_FREQUENT` of them, whatever the input.  With them goes a bound of the
    bytes that all buckets will hold: of every super-k-mer, and of digests for the frequent ones.
    """

    def count(batches):
        for batch in batches:
            found, size = [], 0
            for _, _, text, word_starts, word_ends in _each(batch, window):
                minis, starts, counts = super_kmers(hashes_of(text, word_starts, word_ends), window, gram)
                found.append(minis)
                size += int((word_ends[starts + counts + window - 2] - word_starts[starts]).sum())
            if found:
                minis, n = np.unique(np.concatenate(found), return_counts=True)
                size += np.dtype(STRINGS).itemsize * int(n.sum())
                # The bytes go without a minimiser.
                names = pa.concat_arrays([pa.array(minis.view(np.int64)), pa.nulls(1, pa.int64())])
                yield pa.RecordBatch.from_arrays([names, pa.array(np.append(n, size).astype(np.int64))], ["mini", "n"])

    counted = rows.mapInArrow(count, "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n"))
    counted = staged(counted.filter((F.col("n") > least) | F.col("mini").isNull()), "frequent")
    sums = {r["whole"]: r["n"] for r in counted.groupBy(F.col("mini").isNull().alias("whole")).agg(F.sum("n").alias("n")).collect()}
    size, many = sums.get(True, 0), sums.get(False, 0)
    if not many:
        return np.empty(0, np.uint64), size
    # Each of them has more than a MOST_FREQUENT-th of all their places, so they cannot be more.
    found = counted.filter(F.col("n") > many // MOST_FREQUENT).filter("mini is not null").select("mini").collect()
    # A super-k-mer has no more windows than a window has places for its minimiser.
    size += many * (window - gram + 1) * np.dtype(DIGESTS).itemsize
    return np.sort(np.array([r["mini"] for r in found], np.int64).view(np.uint64)), size


def _dealt(docs: DataFrame, window: int, gram: int, frequent: int, buckets: int | None) -> DataFrame:
    """The packed rows of all tasks, by bucket.

    The number of buckets follows from what they hold, so that a bucket, which one task unpacks whole,
    does not grow with the input; the partitions that they are dealt to follow from it.
    """
    rows = _rows(docs)
    minis, size = _frequent(rows, window, gram, frequent)
    hot = docs.sparkSession.sparkContext.broadcast(minis)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = buckets or max(BUCKETS_PER_TASK * partitions, -(-size // BUCKET))

    def pack(batches):
        packer = Packer(n_buckets, window, hot.value)
        for batch in batches:
            for doc, mark, *words in _each(batch, window):
                # A null id travels as -1: the mark tells it apart from another text with that id.
                packer.add(-1 if doc is None else doc, mark, *words, gram)
                if packer.size >= FLUSH:
                    yield packer.packed()
        yield packer.packed()

    kinds = "bucket int, n_strings int, n_digests int, n_runs int, strings binary, digests binary, runs binary, text binary"
    packed = rows.mapInArrow(pack, kinds)
    tasks = n_buckets // BUCKETS_PER_TASK
    return packed.repartition(tasks, "bucket") if tasks > partitions else packed


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, frequent: int = FREQUENT, buckets: int | None = None) -> DataFrame:
    """Where windows lie that occur more than once: runs (`doc_id`, `mark`, `start`, `n`) of windows.

    For frequent minimisers the runs have all their windows, and those that occur once follow with an
    `n` of 0.  Runs are distinct, however often a row is repeated.
    """

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        def all_of(kind: str, form: list) -> np.ndarray:
            return np.concatenate([records_of(c, n, form) for c, n in zip(rows[kind], rows[f"n_{kind}"].tolist())])

        unpack = zstandard.ZstdDecompressor().decompress
        text = b"".join(unpack(t) for t in rows["text"] if t is not None)
        entries = all_of("strings", STRINGS)
        which, first, n = repeated_in_bucket(entries, text, window)
        once = combined(all_of("digests", DIGESTS)) if rows["n_digests"].any() else np.empty(0, DIGESTS)
        once, passed = once[once["n"] == 1], all_of("runs", RUNS)
        join = lambda *parts: np.concatenate([p.astype(np.int64) for p in parts])
        mine = entries[which]
        runs = pd.DataFrame(
            {
                "doc_id": join(mine["doc"], passed["doc"], once["doc"]),
                "mark": join(mine["mark"], passed["mark"], once["mark"]),
                "start": join(mine["start"].astype(np.int64) + first, passed["start"], once["start"]),
                "n": join(n, passed["n"], np.zeros(len(once))),
            }
        )
        # Equal runs, from copies of a row, have equal minimisers and so meet in this bucket.
        return runs.drop_duplicates()

    dealt = _dealt(docs, window, gram, frequent, buckets)
    return dealt.groupBy("bucket").applyInPandas(count, "doc_id long, mark long, start long, n long")


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, frequent: int = FREQUENT, buckets: int | None = None) -> DataFrame:
    """`doc_id`, `text` (the words that stay, joined by a blank), `n_words`, `n_removed` for every row.

    Removed is each word that is covered by a window of `window` consecutive words which also starts
    anywhere else in the input, the same document included.  Words are what blanks and the control
    characters from tab to carriage return separate; a null text has none.  Rows are documents of their
    own, so a repeated row loses all words of its windows; ids may be null.  Other columns are not
    looked at.
    """
    runs = repeated_windows(docs, window, gram, frequent, buckets)
    marks = runs.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("runs")).withColumnRenamed("doc_id", "id")
    rows = _rows(docs).withColumn("id", F.coalesce("doc_id", F.lit(-1)))
    joined = rows.join(marks, ["id", "mark"], "left").select("doc_id", "text", "runs")

    def run(batches):
        for batch in batches:
            out = []
            for text, found in zip(byte_texts(batch.column(1)), batch.column(2)):
                even = canonical(text)
                size = even.count(b" ") + 1 if even else 0
                if not found.is_valid:
                    out.append((even, size, 0))
                    continue
                words, stay = even.split(b" "), _kept(size, found.values.flatten(), window).tolist()
                out.append((b" ".join([words[i] for i in stay]), size, size - len(stay)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.binary()).cast(pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())],
                ["doc_id", "text", "n_words", "n_removed"],
            )

    return joined.mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")


def _kept(size: int, runs: list[pa.Array], window: int) -> np.ndarray:
    """Places of the words that no repeated window covers."""
    start, n = (c.to_numpy() for c in runs)
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, start, np.sign(n))
    np.add.at(change, start + n, -np.sign(n))
    repeated = np.cumsum(change) > 0
    repeated[start[n == 0]] = False
    first = np.flatnonzero(repeated)
    cover = np.zeros(size + 1, np.int64)
    cover[first] += 1
    cover[first + window] -= 1
    return np.flatnonzero(np.cumsum(cover)[:-1] == 0)


def report(docs: DataFrame) -> DataFrame:
    """`doc_id`, `n_words`, `n_removed`, `kept_sha256`; see `deduplicated`."""
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
