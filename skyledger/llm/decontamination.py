"""Benchmark decontamination with suffix arrays over the training documents.

The training documents are the side that is indexed: every task builds a suffix array over the words of
the documents it holds, a shard, and binary-searches every suffix of the test items in it.  That gives,
for each test suffix, its longest verbatim match in the shard and where it lies, and all places of its
first 13 words.  Documents never move.  Test items come in blocks of bounded size; more of them mean
more passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skyledger.llm.common import byte_texts, staged

WINDOW = 13  # words
BLOCK = 16 << 20  # characters of test items that tasks hold at a time

# A-Z in lower case; what is no letter, digit or non-ASCII byte separates words.
PLAIN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PLAIN).split()


@dataclass(frozen=True)
class Tests:
    """A block of test items: all their words one after another, as numbers from 1 on, 0 behind each item."""

    number_of: dict[bytes, int]
    names: list[str]  # of the items
    words: np.ndarray
    item: np.ndarray  # by suffix
    start: np.ndarray
    offset: np.ndarray
    need: np.ndarray  # words that make a window at this suffix; 0 if none starts there

    @classmethod
    def of(cls, rows: list[tuple[str | None, bytes | None]]) -> Tests:
        """Items without words have no suffixes; an item without an id goes by the empty text."""
        items = [(name or "", words_of(text)) for name, text in rows]
        number_of = {w: n + 1 for n, w in enumerate(sorted({w for _, words in items for w in words}))}
        stream: list[int] = []
        suffixes: list[tuple[int, int, int, int]] = []
        for k, (_, words) in enumerate(items):
            size, at = len(words), len(stream)
            for j in range(size):
                starts_window = j + WINDOW <= size or (j == 0 and size < WINDOW)
                suffixes.append((k, at + j, j, min(size, WINDOW) if starts_window else 0))
            stream += [number_of[w] for w in words] + [0]
        table = np.array(suffixes, np.int64).reshape(-1, 4).T
        return cls(number_of, [name for name, _ in items], np.array(stream, np.int64), *table)

    def pairs(self) -> np.ndarray:
        """The first two words of all suffixes, sorted."""
        return np.unique(self.words[self.start] << 32 | self.words[self.start + 1])

    def single(self) -> np.ndarray:
        """The items of one word."""
        return self.words[self.start[self.need == 1]]


class Shard:
    """The documents of a batch with a suffix array over their words.

    Only places whose first two words begin some test suffix are sorted, or whose first word is a whole
    item: no others can match.  Words that no test item has are 0 and end a match.
    """

    def __init__(self, texts: list[bytes | None], tests: Tests):
        numbers = [np.fromiter(map(tests.number_of.get, words, repeat(0)), np.int64) for words in map(words_of, texts)]
        self.sizes = np.array([len(n) for n in numbers], np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.words = np.concatenate([part for n in numbers for part in (n, [0])] + [np.zeros(2, np.int64)]).astype(np.int64)
        depth = int(np.diff(np.flatnonzero(tests.words == 0), prepend=-1).max(initial=1))
        self.suffixes = self._sorted(tests.pairs(), tests.single(), depth)

    def _sorted(self, pairs: np.ndarray, single: np.ndarray, depth: int) -> np.ndarray:
        words = self.words
        here = np.flatnonzero(words)
        if not len(pairs):
            return here[:0]
        both = words[here] << 32 | words[here + 1]
        begins = (words[here + 1] > 0) & (pairs[np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)] == both)
        places = here[begins | np.isin(words[here], single)]
        rank = np.zeros(len(places), np.int64)
        open_ = np.arange(len(places))  # those whose order is not settled
        for at in range(0, depth, 2):
            if not len(open_):
                break
            first = np.minimum(places[open_] + at, len(words) - 2)
            key = words[first] << 32 | np.where(words[first] > 0, words[first + 1], 0)
            order = np.lexsort((key, rank[open_]))
            r, k = rank[open_][order], key[order]
            new = np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]))
            group = np.cumsum(new) - 1
            # Ranks stay within the span of the group that is cut up.
            first_of = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            base = np.repeat(first_of, np.diff(np.append(first_of, len(r))))
            inside = np.flatnonzero(new)[group] - base
            rank[open_[order]] = r + inside
            sizes = np.bincount(group)
            more = (sizes[group] > 1) & (k & 0xFFFFFFFF > 0)
            open_ = open_[order][more]
        return places[np.lexsort((places, rank))]

    def _bound(self, low: np.ndarray, high: np.ndarray, at: int, word: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of each interval for the first suffix whose word `at` is not smaller (or larger)."""
        low, high = low.copy(), high.copy()
        while (busy := low < high).any():
            middle = (low + high) >> 1
            theirs = self.words[np.minimum(self.suffixes[np.where(busy, middle, 0)] + at, len(self.words) - 1)]
            further = busy & ((theirs <= word) if right else (theirs < word))
            low = np.where(further, middle + 1, low)
            high = np.where(busy & ~further, middle, high)
        return low

    def search(self, tests: Tests) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Per test suffix the length of its longest match and one place of it; all windows that occur.

        A window is (suffix, first, last) with its places in `suffixes[first:last]`.
        """
        n = len(tests.start)
        length, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        found: list[tuple[int, int, int]] = []
        if not len(self.suffixes):
            return length, place, found
        live, low, high = np.arange(n), np.zeros(n, np.int64), np.full(n, len(self.suffixes))
        at = 0
        while len(live):
            word = tests.words[tests.start[live] + at]
            first = self._bound(low, high, at, word, right=False)
            last = self._bound(first, high, at, word, right=True)
            on = (word > 0) & (first < last)
            live, low, high = live[on], first[on], last[on]
            at += 1
            length[live], place[live] = at, self.suffixes[low]
            full = tests.need[live] == at
            found += zip(live[full].tolist(), low[full].tolist(), high[full].tolist())
        return length, place, found

    def document_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def hits(self, tests: Tests) -> tuple[np.ndarray, list[set[str]]]:
        """Which words lie in a window that occurs, and per document the items it has a window of."""
        cover = np.zeros(len(self.words) + 1, np.int64)
        items: list[set[str]] = [set() for _ in self.sizes]
        for suffix, first, last in self.search(tests)[2]:
            places = self.suffixes[first:last]
            cover[places] += 1  # places of one window are distinct
            cover[places + tests.need[suffix]] -= 1
            for doc in np.unique(self.document_of(places)).tolist():
                items[doc].add(tests.names[tests.item[suffix]])
        return np.cumsum(cover)[:-1] > 0, items


def _blocks(benchmark: DataFrame, size: int) -> tuple[int, Iterator[Broadcast]]:
    """The number of blocks of about `size` characters of test items, and the blocks, broadcast one at a time.

    Equal rows count once.  A block is collected when it is asked for and released after that; an item
    longer than a block is one of its own with whatever shares its number.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("string"))
    items = staged(items.filter("text is not null").distinct(), "test-items")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-chars // size))
    part = F.pmod(F.xxhash64("name", "text"), F.lit(count))

    def each() -> Iterator[Broadcast]:
        for number in range(count):
            rows = items.filter(part == number).select("name", F.encode("text", "UTF-8").alias("text")).collect()
            block = spark.sparkContext.broadcast(Tests.of([(r["name"], bytes(r["text"])) for r in rows]))
            yield block
            block.destroy()

    return count, each()


HITS = T.StructType(
    [
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("names", T.ArrayType(T.StringType())),
    ]
)


def _hits(texts: list[bytes | None], tests: Tests) -> list[dict | None]:
    """Per text the runs of words that windows cover and the items they are of; None without any."""
    shard = Shard(texts, tests)
    cover, items = shard.hits(tests)
    out: list[dict | None] = []
    for start, size, names in zip(shard.starts.tolist(), shard.sizes.tolist(), items):
        starts, ends = _runs(cover[start : start + size]) if names else ([], [])
        out.append({"starts": starts, "ends": ends, "names": sorted(names)} if names else None)
    return out


Verdict = tuple[int, int, list[str]]  # words, hit words, names of the items in order


def _judged_rows(
    docs: DataFrame, benchmark: DataFrame, size: int, finish: Callable[[pa.RecordBatch, list[Verdict]], pa.RecordBatch], schema: T.StructType
) -> DataFrame:
    """What `finish` makes of the batches of `docs` and the verdicts on their rows.

    If all items are one block, that is one pass by one Python worker per task.  Otherwise the rows are
    written with a number, each block is one search over all of them whose finds are written before the
    next block is loaded, and what several blocks find in a row comes back by its number.
    """
    place, kept = docs.columns.index("text"), len(docs.columns)
    count, blocks = _blocks(benchmark, size)
    if count == 1:
        only = next(blocks)

        def at_once(batches):
            for batch in batches:
                texts = byte_texts(batch.column(place))
                yield finish(batch, list(map(_judged, texts, _hits(texts, only.value))))

        return docs.mapInArrow(at_once, schema)

    row, column = _unused(docs.columns, "row"), _unused(docs.columns, "found")
    kind = to_arrow_type(HITS)
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"))
    parts = []
    for block in blocks:

        def search(batches, block=block):
            for batch in batches:
                found = pa.array(_hits(byte_texts(batch.column(1)), block.value), kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), found], ["row", "found"]).filter(found.is_valid())

        schema_found = T.StructType([T.StructField("row", T.LongType()), T.StructField("found", HITS)])
        parts.append(staged(texts.mapInArrow(search, schema_found), "found"))
    # At most one row per block and document.
    joined = [F.flatten(F.collect_list(f"found.{c}")).alias(c) for c in HITS.names]
    merged = reduce(DataFrame.unionByName, parts).groupBy(F.col("row").alias(row)).agg(*joined)
    found = numbered.join(merged.select(row, F.struct(*HITS.names).alias(column)), row, "left").select(*docs.columns, column)

    def from_finds(batches):
        for batch in batches:
            verdicts = list(map(_judged, byte_texts(batch.column(place)), batch.column(kept).to_pylist()))
            yield finish(batch.select(list(range(kept))), verdicts)

    return found.mapInArrow(from_finds, schema)


def _runs(cover: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()


def _judged(text: bytes | None, found: dict | None) -> Verdict:
    words = len(words_of(text))
    if found is None:
        return words, 0, []
    change = np.zeros(words + 1, np.int64)
    np.add.at(change, found["starts"], 1)
    np.add.at(change, found["ends"], -1)
    return words, int((np.cumsum(change)[:-1] > 0).sum()), sorted(set(found["names"]))


def _unused(columns: list[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name


def contaminated(words: int, hit: int) -> bool:
    """At least one word in twenty lies in a window of the benchmark."""
    return hit > 0 and 20 * hit >= words


def report(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """`doc_id`, `n_words`, `n_hit`, `n_items`, `items_sha256`, `contaminated` for every row of `docs`.

    A window is 13 consecutive words of a test item, or all words of a shorter one.  A null or empty
    text has no words; nor has a benchmark item without text.  Items with the same id count as one.
    Rows are taken one by one: repeated ones come out repeatedly, a null id stays null.
    """
    source = docs.select("doc_id", F.col("text").cast("string"))

    def finish(batch, found):
        joined = [",".join(names).encode() for _, _, names in found]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.int64()),
                pa.array([len(f[2]) for f in found], pa.int64()),
                pa.array([hashlib.sha256(j).hexdigest() for j in joined], pa.string()),
                pa.array([contaminated(f[0], f[1]) for f in found], pa.bool_()),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    schema = T.StructType([source.schema["doc_id"]]).add("n_words", "long").add("n_hit", "long").add("n_items", "long")
    return _judged_rows(source, benchmark, block, finish, schema.add("items_sha256", "string").add("contaminated", "boolean"))


def cleaned(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of `docs`, unchanged, that are not contaminated."""

    def finish(batch, found):
        return batch.filter(pa.array([not contaminated(words, hit) for words, hit, _ in found], pa.bool_()))

    return _judged_rows(docs, benchmark, block, finish, docs.schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """`item_id`, `offset`, `length`, `doc_id`, `position`: where each test suffix matches longest.

    One row per test suffix that matches at least two words, or the one word that an item has; of equally long matches the one with the
    smallest document and place.  Shards report one match per suffix, the longest are chosen with
    partial maxima.  Items with the same id are told apart by nothing: the longest of them counts.
    """
    names = "item_id string, offset bigint, length bigint, doc_id bigint, position bigint"
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = []
    for block_of in _blocks(benchmark, block)[1]:

        def run(batches, block_of=block_of):
            tests = block_of.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                shard = Shard(byte_texts(batch.column("text")), tests)
                length, place, _ = shard.search(tests)
                got = np.flatnonzero(length)
                doc = shard.document_of(place[got])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tests.names[i] for i in tests.item[got]], pa.string()),
                        pa.array(tests.offset[got]),
                        pa.array(length[got]),
                        pa.array([ids[d] for d in doc.tolist()], pa.int64()),
                        pa.array(place[got] - shard.starts[doc]),
                    ],
                    ["item_id", "offset", "length", "doc_id", "position"],
                )

        parts.append(staged(source.mapInArrow(run, names), "matches"))
    found = reduce(DataFrame.unionByName, parts)
    best = F.min(F.struct(-F.col("length"), "doc_id", "position")).alias("best")
    return found.groupBy("item_id", "offset").agg(best).select(
        "item_id", "offset", (-F.col("best.col1")).alias("length"), "best.doc_id", "best.position"
    )
