"""Ranked lexical search: MaxScore with bounds for pairs of terms.

Documents are indexed in shards of a few megabytes, one row each, with a posting list per term.  For a set
of queries the lists of their terms get their impacts (what a term adds to a document's score) and the
largest impact of each list; and for pairs of terms of a query, the intersection of their lists with the
largest joint impact.  MaxScore sorts a query's terms by their maxima and leaves out the lists of the
lowest, the non-essential ones, as long as their maxima together stay below the score to beat: no
document found in these lists alone can matter.  A pair's bound, the largest of its joint impact and the
two single maxima, is never above the sum of the two maxima and mostly far below, as rare terms hardly
meet; so more lists are non-essential, and more shards are skipped whole.

The result is exact.  Scores are whole numbers, see `Weights`.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import byte_texts, row_by_row, staged
from skyledger.llm.decontamination import words_of

DEPTH = 50  # documents per query
SHARD = 4 << 20  # bytes of text in a shard
BLOCK = 16 << 20  # bytes of query terms that are searched for at a time
LENGTH_SHARE = 50  # per cent of a document's length that its score is normalised by
SATURATION = 20  # of the count of a term
FANIN = 256  # tasks whose finds are merged at once

NO_ID = np.iinfo(np.int64).max  # stands for a null id, so that it comes last

INDEX = (
    "doc_ids array<bigint>, sizes array<int>, terms array<string>, starts array<int>, places array<int>, tfs array<int>, "
    "n_docs bigint, n_terms bigint"
)
IMPACTS = (
    "doc_ids array<bigint>, terms array<int>, starts array<int>, places array<int>, impacts array<bigint>, "
    "pairs array<int>, pair_starts array<int>, pair_places array<int>, pair_impacts array<bigint>"
)
FOUND = "query int, doc_id bigint, score bigint"


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _arrays(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _row(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of one row; arrays become lists."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(lists, list(columns))


def build_index(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The index of all documents: a row per shard, with its documents, terms and posting lists.

    A task cuts its documents into shards of about `shard` bytes; a longer text is one of its own.  The
    result is a written table, which tasks read a shard at a time however many there are in a file.  Terms are runs of letters, digits and non-ASCII characters with A-Z in
    lower case; texts that are null or empty have none.
    """

    def run(batches):
        ids, sizes, numbers, counts, number_of, size = [], [], [], [], _Numbers(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text"))):
                if ids and size + len(text or b"") > shard:
                    yield pack(ids, sizes, numbers, counts, number_of)
                    ids, sizes, numbers, counts, number_of, size = [], [], [], [], _Numbers(), 0
                words = words_of(text)
                number, count = np.unique(np.fromiter(map(number_of.__getitem__, words), np.int32, len(words)), return_counts=True)
                ids.append(doc_id)
                sizes.append(len(words))
                numbers.append(number)
                counts.append(count)
                size += len(text or b"")
        if ids:
            yield pack(ids, sizes, numbers, counts, number_of)

    def pack(ids, sizes, numbers, counts, number_of):
        term = np.concatenate(numbers)
        order = np.argsort(term, kind="stable")
        places = np.repeat(np.arange(len(ids), dtype=np.int32), [len(n) for n in numbers])[order]
        starts = np.searchsorted(term[order], np.arange(len(number_of) + 1)).astype(np.int32)
        lists = _row(
            {
                "doc_ids": pa.array([NO_ID if i is None else i for i in ids], pa.int64()),
                "sizes": pa.array(sizes, pa.int32()),
                "terms": pa.array([t.decode() for t in number_of], pa.string()),
                "starts": pa.array(starts),
                "places": pa.array(places),
                "tfs": pa.array(np.concatenate(counts)[order].astype(np.int32)),
            }
        )
        with_terms = sum(s > 0 for s in sizes)
        return lists.append_column("n_docs", pa.array([with_terms], pa.int64())).append_column("n_terms", pa.array([sum(sizes)], pa.int64()))

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return staged(source.mapInArrow(run, INDEX), "lexical-index", large=True)


@dataclass(frozen=True)
class Weights:
    """What a score follows from: a term's weight, and documents and terms of the whole collection.

    A term in `df` of N documents weighs floor(1000 * ln((2N + 2) / (2df + 1))).  With tf occurrences in a
    document of n of the L terms, it adds weight * (10^9 * tf div (1000 * tf + 20 * m)), where
    m = 100 - 50 + (50 * n * N div L).
    """

    docs: int
    terms: int
    of: np.ndarray

    @classmethod
    def from_counts(cls, docs: int, terms: int, df: np.ndarray) -> Weights:
        return cls(docs, terms, np.array([int(1000 * log((2 * docs + 2) / (2 * d + 1)) // 1) for d in df.tolist()], np.int64))

    def shares(self, sizes: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """What occurrences add per unit of weight, in documents of these sizes."""
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * sizes.astype(np.int64) * self.docs // max(self.terms, 1)
        tfs = tfs.astype(np.int64)
        return 1_000_000_000 * tfs // (1000 * tfs + SATURATION * m)


@dataclass(frozen=True)
class Queries:
    """A block of queries: their terms by number, and the pairs of terms that are intersected."""

    names: list[str | None]
    terms: list[str]
    of: list[np.ndarray]  # per query its terms

    @classmethod
    def of_rows(cls, rows: list[tuple[str | None, str]]) -> Queries:
        number_of, by_name = _Numbers(), {}
        for name, term in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])):
            by_name.setdefault(name, []).append(number_of[term])
        return cls(list(by_name), list(number_of), [np.array(t, np.int64) for t in by_name.values()])

    def pairs(self, weights: np.ndarray) -> Pairs:
        """Neighbours in order of weight: two heavy terms that seldom meet save the most."""
        number_of, units = _Numbers(), []
        for terms in self.of:
            heavy = terms[np.lexsort((terms, -weights[terms]))]
            heavy = heavy[weights[heavy] > 0].tolist()
            paired = [number_of[pair] for pair in zip(heavy[::2], heavy[1::2])]
            units.append((np.array(paired, np.int64), heavy[-1] if len(heavy) % 2 else None))
        return Pairs(np.array(list(number_of), np.int64).reshape(-1, 2), units)


@dataclass(frozen=True)
class Pairs:
    """The pairs of terms, and per query its pairs and the term that is left over."""

    terms: np.ndarray  # pairs x 2
    of: list[tuple[np.ndarray, int | None]]


def document_frequencies(index: DataFrame, terms: list[str]) -> np.ndarray:
    """In how many documents each term occurs; the driver gets a number per term."""
    wanted = index.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))

    def run(batches):
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for row in range(len(batch)):
                at = pc.index_in(batch.column("terms")[row].values.cast(pa.string()), wanted.value)
                held = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
                total[at.drop_null().to_numpy()] += np.diff(_arrays(batch, "starts", row))[held]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "df"])

    counted = index.select("terms", "starts").mapInArrow(run, "term bigint, df bigint")
    df = np.zeros(len(terms), np.int64)
    with row_by_row(index.sparkSession):
        for row in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[row["term"]] = row["df"]
    wanted.destroy()
    return df


def with_impacts(index: DataFrame, queries: Queries, weights: Weights, pairs: Pairs) -> DataFrame:
    """The shards with the posting lists of the queries' terms as impacts, and the intersections of pairs.

    The result is a written table.  A pair is listed where a shard holds both its terms, also if they
    do not meet in any document.
    """
    shared = index.sparkSession.sparkContext.broadcast((pa.array(queries.terms, pa.string()), weights, pairs.terms))

    def run(batches):
        wanted, weights, pair_terms = shared.value
        for batch in batches:
            for row in range(len(batch)):
                at = pc.index_in(batch.column("terms")[row].values.cast(pa.string()), wanted)
                held = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
                number = at.drop_null().to_numpy().astype(np.int64)
                starts, sizes = _arrays(batch, "starts", row), _arrays(batch, "sizes", row)
                places, tfs = _arrays(batch, "places", row), _arrays(batch, "tfs", row)
                heavy = weights.of[number] > 0
                held, number = held[heavy], number[heavy]
                listed = {}
                for term, first, last in zip(number.tolist(), starts[held].tolist(), starts[held + 1].tolist()):
                    here = places[first:last]
                    listed[term] = (here, weights.of[term] * weights.shares(sizes[here], tfs[first:last]))
                met = {}
                for pair, (a, b) in enumerate(pair_terms.tolist()):
                    if a in listed and b in listed:
                        both, i, j = np.intersect1d(listed[a][0], listed[b][0], assume_unique=True, return_indices=True)
                        met[pair] = (both, listed[a][1][i] + listed[b][1][j])
                yield _row(
                    {
                        "doc_ids": batch.column("doc_ids")[row].values,
                        **_lists(listed, ("terms", "starts", "places", "impacts")),
                        **_lists(met, ("pairs", "pair_starts", "pair_places", "pair_impacts")),
                    }
                )

    source = index.select("doc_ids", "sizes", "terms", "starts", "places", "tfs")
    with row_by_row(index.sparkSession):
        found = staged(source.mapInArrow(run, IMPACTS), "lexical-impacts", large=True)
    shared.destroy()
    return found


def _lists(listed: dict[int, tuple[np.ndarray, np.ndarray]], names: tuple[str, ...]) -> dict[str, pa.Array]:
    """Posting lists one after another, by number."""
    keys, starts = list(listed), np.cumsum([0, *(len(places) for places, _ in listed.values())])
    places = np.concatenate([np.empty(0, np.int32), *(p for p, _ in listed.values())])
    impacts = np.concatenate([np.empty(0, np.int64), *(i for _, i in listed.values())])
    columns = (pa.array(keys, pa.int32()), pa.array(starts, pa.int32()), pa.array(places, pa.int32()), pa.array(impacts, pa.int64()))
    return dict(zip(names, columns))


@dataclass
class Shard:
    """The lists of a shard with their maxima; `touched` counts the postings that queries looked at."""

    size: int
    lists: dict[int, tuple[np.ndarray, np.ndarray, int]]
    pairs: dict[int, tuple[np.ndarray, np.ndarray, int]]
    touched: int = 0

    @classmethod
    def of(cls, batch: pa.RecordBatch, row: int) -> Shard:
        def lists(names):
            keys, starts, places, impacts = (_arrays(batch, n, row) for n in names)
            cut = [(places[a:b], impacts[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            return {k: (p, i, int(i.max(initial=0))) for k, (p, i) in zip(keys.tolist(), cut)}

        return cls(
            len(batch.column("doc_ids")[row]),
            lists(("terms", "starts", "places", "impacts")),
            lists(("pairs", "pair_starts", "pair_places", "pair_impacts")),
        )

    def units(self, pairs: Pairs, query: int) -> list[tuple[int, list[int]]]:
        """Bounds of the query's pairs and single terms here, the smallest first, with their terms."""
        paired, single = pairs.of[query]
        units = []
        for pair in paired.tolist():
            terms = [t for t in pairs.terms[pair].tolist() if t in self.lists]
            joint = self.pairs[pair][2] if pair in self.pairs else 0
            if terms:
                units.append((max(joint, *(self.lists[t][2] for t in terms)), terms))
        if single in self.lists:
            units.append((self.lists[single][2], [single]))
        return sorted(units)

    def seed(self, pairs: Pairs, query: int, depth: int) -> int:
        """A score that `depth` documents reach for sure, by their joint impacts alone; 0 if unknown."""
        best = 0
        for pair in pairs.of[query][0].tolist():
            _, joint, most = self.pairs.get(pair, (None, (), 0))
            if len(joint) >= depth and most > best:
                self.touched += len(joint)
                best = max(best, int(np.partition(joint, len(joint) - depth)[len(joint) - depth]))
        return best

    def search(self, pairs: Pairs, query: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents whose score is at least `least`, and above 0."""
        units = self.units(pairs, query)
        reach = np.cumsum([bound for bound, _ in units]) if units else np.empty(0, np.int64)
        least = max(least, 1)
        # Documents found in the units before this one alone stay below.
        essential = int(np.searchsorted(reach, least))
        if essential == len(units):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        scores = np.zeros(self.size, np.int64)
        for _, terms in units[essential:]:
            for term in terms:
                places, impacts, _ = self.lists[term]
                scores[places] += impacts
                self.touched += len(places)
        live = np.flatnonzero(scores)
        for number in range(essential - 1, -1, -1):
            live = live[scores[live] + reach[number] >= least]
            if not len(live):
                break
            for term in units[number][1]:
                places, impacts, _ = self.lists[term]
                self.touched += min(len(live), len(places))
                if len(live) < len(places):
                    at = np.minimum(np.searchsorted(places, live), len(places) - 1)
                    scores[live] += np.where(places[at] == live, impacts[at], 0)
                else:
                    scores[places] += np.where(scores[places] > 0, impacts, 0)
        live = live[scores[live] >= least]
        return live, scores[live]


class Best:
    """The best documents of a query so far."""

    def __init__(self, depth: int):
        self.depth, self.ids, self.scores = depth, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """The score that a further document must reach."""
        return int(self.scores[-1]) if len(self.scores) == self.depth else 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.append(self.ids, ids), np.append(self.scores, scores)
        order = np.lexsort((ids, -scores))[: self.depth]
        self.ids, self.scores = ids[order], scores[order]


def _best(impacts: DataFrame, queries: Queries, pairs: Pairs, depth: int) -> DataFrame:
    """The best documents of every query; the result is a written table."""
    shared = impacts.sparkSession.sparkContext.broadcast((pairs, len(queries.names)))

    def run(batches):
        pairs, count = shared.value
        best = [Best(depth) for _ in range(count)]
        for batch in batches:
            for row in range(len(batch)):
                shard, ids = Shard.of(batch, row), _arrays(batch, "doc_ids", row)
                for query, held in enumerate(best):
                    least = held.least or shard.seed(pairs, query, depth)
                    places, scores = shard.search(pairs, query, least)
                    if len(places):
                        held.add(ids[places], scores)
        sizes = [len(b.ids) for b in best]
        columns = [np.repeat(np.arange(count, dtype=np.int32), sizes)]
        columns += [np.concatenate([np.empty(0, np.int64), *(getattr(b, n) for b in best)]) for n in ("ids", "scores")]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["query", "doc_id", "score"])

    found = impacts.mapInArrow(run, FOUND).withColumn("part", F.floor(F.spark_partition_id() / FANIN))
    # What many tasks found is cut down in groups of them first.
    for keys in (["query", "part"], ["query"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)
    with row_by_row(impacts.sparkSession):
        found = staged(found.select("query", "rank", "doc_id", "score"), "lexical-found")
    shared.destroy()
    return found


def query_terms(items: DataFrame) -> DataFrame:
    """`item_id` (as text), `term`: the distinct terms of every item; items with one id are one query."""

    def run(batches):
        for batch in batches:
            terms = [sorted(set(words_of(text))) for text in byte_texts(batch.column("text"))]
            ids = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            flat = pa.array([t.decode() for ts in terms for t in ts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(ids)), flat], ["item_id", "term"])

    source = items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return source.distinct().mapInArrow(run, "item_id string, term string").distinct()


def search(index: DataFrame, items: DataFrame, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """`item_id`, `rank`, `doc_id`, `score`: the `depth` best documents of the index for every item.

    Only scores above 0 count; equal ones rank by id, a document without an id last.  Repeated
    documents are found repeatedly.  Items with one id are one query with the terms of all; an item without
    terms finds nothing, and one without an id is a query with a null id.  Other columns are not looked
    at.  Items are searched for in blocks of about `block` bytes of distinct terms, which are what the driver
    and every task hold at a time.
    """
    spark, kind = index.sparkSession, dict(items.dtypes)["item_id"]
    terms = staged(query_terms(items), "lexical-queries")
    docs, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    count = -(-(terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0) // block)
    result = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    part = F.pmod(F.xxhash64("item_id"), F.lit(max(count, 1)))
    for number in range(count):
        rows = terms.filter(part == number).collect()
        if not rows or not docs:
            continue
        queries = Queries.of_rows([(r["item_id"], r["term"]) for r in rows])
        weights = Weights.from_counts(docs, total, document_frequencies(index, queries.terms))
        pairs = queries.pairs(weights.of)
        best = _best(with_impacts(index, queries, weights, pairs), queries, pairs, depth)
        names = F.broadcast(spark.createDataFrame(list(enumerate(queries.names)), "query int, item_id string"))
        result = result.union(
            best.join(names, "query").select(
                F.col("item_id").cast(kind), "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")), "score"
            )
        )
    return result
