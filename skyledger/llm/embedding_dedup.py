"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors are projected on many random lines.  Two vectors at a small angle lie close to each other on
nearly every line, others on few; so pairs are told by the number of lines on which one lies in a
window centred at the other, and those with enough collisions are verified by their cosine.

Every line lets a fixed share of all pairs collide, which would make counting quadratic.  So a first
set of lines, cut close to the median of the sorted projections, puts vectors into cells, several times with
other lines; collisions are counted within cells.  Cells hold a fixed number of vectors on average,
whatever the number of vectors.  How many such tables there are, and how many collisions a pair needs,
is calibrated for the wanted recall: vectors of a bounded sample get artificial partners exactly at the
threshold, and the figures are set so that the wanted share of them is found, and of the sample's links.

A pair that shares cells in several tables is counted in the first of them only, which both vectors
tell; so no pair is ever emitted.  Vectors get their number of links, and a label within the cell that
connects it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import components, staged

THRESHOLD = 0.95
RECALL = 0.998  # of pairs exactly at the threshold, for the tables and again for the counts
CELL = 32  # vectors of a cell, on average
LARGEST = 1024  # vectors of a cell that one task compares with each other
LINES = 40  # on which collisions are counted
WIDTH = 1.3  # half a window, in standard deviations of a pair at the threshold
TABLES = 96  # at most
SAMPLE = 4096  # vectors that medians, tables and counts are calibrated on, on average
PAIRS = 20_000  # links among them that are looked at
SEED = 20
BLOCK = 64  # vectors that are projected at once
MIDDLE = 0.02  # how far from the median a cut may lie, as a share of the ranks
NARROW = 1e-9  # gaps below this are due to rounding


@lru_cache(maxsize=8)
def lines(dimension: int, count: int, kind: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimension, kind]).standard_normal((dimension, count))


def projected(unit: np.ndarray, cast: np.ndarray) -> np.ndarray:
    """`unit @ cast`, in blocks of one size.

    The last bit of a matrix product depends on the shape of the matrix.  A vector's cells are computed
    by several tasks, among other vectors each time, and must not differ.
    """
    blocks = -(-len(unit) // BLOCK)
    padded = np.zeros((blocks * BLOCK, unit.shape[1]))
    padded[: len(unit)] = unit
    out = np.empty((len(padded), cast.shape[1]))
    for start in range(0, len(padded), BLOCK):
        np.matmul(padded[start : start + BLOCK], cast, out=out[start : start + BLOCK])
    return out[: len(unit)]


def cuts(values: np.ndarray) -> np.ndarray:
    """Where to cut each column near its median: in the middle of a gap, so that no value lies on a cut.

    The widest gap among the middle ranks is taken.  Where they are all alike, the cut lies beyond them.
    """
    ranked = np.sort(values, axis=0)
    middle, about = len(ranked) // 2, int(MIDDLE * len(ranked)) + 1
    window = ranked[max(0, middle - about) : middle + about + 1]
    if len(window) < 2:
        return window[-1] + NARROW
    widest = np.diff(window, axis=0).argmax(axis=0)[None]
    below, above = (np.take_along_axis(window, widest + k, axis=0)[0] for k in (0, 1))
    return np.where(above - below > NARROW, (below + above) / 2, window[-1] + NARROW)


@dataclass(frozen=True)
class Plan:
    """What all tasks agree on, for vectors of one number of dimensions."""

    threshold: float
    bits: int  # lines that make a cell
    tables: int
    medians: np.ndarray
    least: int  # collisions

    @property
    def half_window(self) -> float:
        return WIDTH * float(np.sqrt(2 - 2 * self.threshold))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table."""
        sides = projected(unit, lines(unit.shape[1], len(self.medians), 0)[:, : self.tables * self.bits]) > self.medians[: self.tables * self.bits]
        weights = np.left_shift(np.int64(1), np.arange(self.bits, dtype=np.int64))
        return sides.reshape(len(unit), self.tables, self.bits).astype(np.int64) @ weights

    def collisions(self, unit: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many windows of each vector each of the others lies in."""
        count = np.zeros((len(unit), len(other)), np.uint8)
        cast = lines(unit.shape[1], LINES, 1)
        mine, theirs = unit @ cast, other @ cast
        for line in range(LINES):
            order = np.argsort(theirs[:, line], kind="stable")
            ranked = theirs[order, line]
            first = np.searchsorted(ranked, mine[:, line] - self.half_window, "left")
            last = np.searchsorted(ranked, mine[:, line] + self.half_window, "right")
            places = np.empty(len(other), np.int64)
            places[order] = np.arange(len(other))
            count += (places >= first[:, None]) & (places < last[:, None])
        return count


def _partners(sample: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs to calibrate on: at exactly the threshold in random directions, and the sample's own links."""
    away = np.random.default_rng([SEED, 2]).standard_normal(sample.shape)
    away -= (away * sample).sum(axis=1, keepdims=True) * sample
    size = np.linalg.norm(away, axis=1, keepdims=True)
    away = np.divide(away, size, out=np.zeros_like(away), where=size > 0)
    made = threshold * sample + np.sqrt(1 - threshold**2) * away
    first, second = np.nonzero(np.triu(sample @ sample.T >= threshold, 1))
    some = np.unique(np.linspace(0, max(0, len(first) - 1), PAIRS).astype(np.int64))[: len(first)]
    pairs = [(sample, made)]
    return pairs + [(sample[first[some]], sample[second[some]])] * bool(len(first))


def calibrated(sample: np.ndarray, vectors: int, threshold: float) -> Plan:
    """The plan for so many vectors like those of the sample.

    Where `TABLES` tables do not reach the recall, as with vectors that all lie in one place, cells
    get larger; at worst there is one, whose parts are all compared.
    """
    dimension = sample.shape[1]
    pairs = _partners(sample, threshold)
    bits = int(np.clip(np.ceil(np.log2(max(2, vectors) / CELL)), 0, 40))
    medians, tables = np.empty(0), 1
    while bits:
        medians = cuts(projected(sample, lines(dimension, TABLES * bits, 0)))
        whole = Plan(threshold, bits, TABLES, medians, 0)
        found = [np.maximum.accumulate(whole.cells(a) == whole.cells(b), axis=1).mean(axis=0) for a, b in pairs]
        tables = int(np.searchsorted(np.minimum.reduce(found), RECALL)) + 1
        if tables <= TABLES:
            break
        bits, tables = bits - 1, 1
    medians = medians if bits else np.empty(0)
    half = Plan(threshold, bits, tables, medians, 0).half_window
    cast = lines(dimension, LINES, 1)
    counts = [(np.abs((a - b) @ cast) <= half).sum(axis=1) for a, b in pairs]
    return Plan(threshold, bits, tables, medians, int(min(np.quantile(c, 1 - RECALL, method="lower") for c in counts)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _prepared(vectors: DataFrame) -> DataFrame:
    """`vec_id`, `digest` of the numbers, `dimension`, `numbers`; the last two null where nothing can link."""

    def run(batches):
        for batch in batches:
            digests, sizes, numbers = [], [], []
            for vec, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                found = None
                if vec is not None and values.is_valid and values.values.null_count == 0 and len(values.values):
                    array = values.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # no negative zero
                    # Scaled first, as squares of large or small numbers leave the range.
                    largest = np.abs(array).max()
                    if np.isfinite(largest) and largest > 0:
                        found = array / largest if largest > 1e100 or largest < 1e-100 else array
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if found is not None else None)
                sizes.append(len(found) if found is not None else None)
                numbers.append(found.tobytes() if found is not None else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(numbers, pa.binary())],
                ["vec_id", "digest", "dimension", "numbers"],
            )

    source = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return source.mapInArrow(run, "vec_id long, digest binary, dimension int, numbers binary")


def _plans(distinct: DataFrame, threshold: float) -> dict[int, Plan]:
    """A plan for each number of dimensions, from a sample by the digests."""
    plans = {}
    for row in distinct.groupBy("dimension").count().collect():
        share = min(1.0, SAMPLE / row["count"])
        draw = F.pmod(F.xxhash64("digest"), F.lit(1_000_000)) < int(np.ceil(1_000_000 * share))
        chosen = distinct.filter((F.col("dimension") == row["dimension"]) & draw).select("numbers").collect()
        if chosen:
            sample = _unit(np.stack([np.frombuffer(r["numbers"], "<f8") for r in chosen]))
            plans[row["dimension"]] = calibrated(sample, row["count"], threshold)
    return plans


def _labels(first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that links reach, by place."""
    label = ids.copy()
    while len(first):
        before = label.copy()
        np.minimum.at(label, first, before[second])
        np.minimum.at(label, second, before[first])
        if (label == before).all():
            break
    return label


def _compare(rows: dict[str, np.ndarray], plan: Plan, table: int) -> Iterator[tuple]:
    """Links of a cell, or of two parts of one: (digest, links, node, label) of the vectors that have any."""
    unit = _unit(np.stack([np.frombuffer(x, "<f8") for x in rows["numbers"]]))
    left = np.flatnonzero(rows["side"] != 1)
    right = np.flatnonzero(rows["side"] != 0)
    near = plan.collisions(unit[left], unit[right]) >= plan.least
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    # Within one part each pair comes twice; vectors that share a side are compared elsewhere.
    once = (i < j) if len(left) == len(unit) else np.ones(len(i), bool)
    i, j = i[once], j[once]
    if not len(i):
        return
    cosine = np.concatenate([np.einsum("ab,ab->a", unit[i[k : k + 100_000]], unit[j[k : k + 100_000]]) for k in range(0, len(i), 100_000)])
    i, j = i[cosine >= plan.threshold], j[cosine >= plan.threshold]
    if not len(i):
        return
    label = _labels(i, j, rows["node"])
    cells = plan.cells(unit)
    first = np.concatenate([(cells[i[k : k + 100_000]] == cells[j[k : k + 100_000]]).argmax(axis=1) for k in range(0, len(i), 100_000)])
    counted = first == table
    links = np.bincount(i[counted], rows["copies"][j[counted]], len(unit)) + np.bincount(j[counted], rows["copies"][i[counted]], len(unit))
    for k in np.unique(np.concatenate([i, j])).tolist():
        yield rows["digest"][k], int(links[k]), int(rows["node"][k]), int(label[k])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, largest: int = LARGEST) -> DataFrame:
    """`vec_id`, `n_links`, `component_id`, `kept` for every row of `vectors`.

    Vectors link if their cosine, in double precision, is at least `threshold`; no pair below it does,
    and of those above nearly all are found (see `RECALL`).  A vector that is null, empty, zero, or has
    null or non-finite parts links with nothing, nor do vectors of different numbers of dimensions.
    Equal vectors are compared as one and count with their number; rows with one id and equal vectors
    are one.  A row without an id links with nothing, has no component and is kept.  Other columns are
    not looked at.
    """
    prepared = staged(_prepared(vectors), "vectors")
    known = prepared.filter("digest is not null")
    copies = F.count_distinct("vec_id").alias("copies")
    distinct = staged(
        known.groupBy("digest").agg(F.min("vec_id").alias("node"), copies, F.any_value("dimension").alias("dimension"), F.any_value("numbers").alias("numbers")),
        "distinct_vectors",
    )
    plans = distinct.sparkSession.sparkContext.broadcast(_plans(distinct, threshold))

    def place(batches):
        for batch in batches:
            for dimension in np.unique(batch.column("dimension").to_numpy()).tolist():
                plan = plans.value[dimension]
                rows = batch.filter(pc.equal(batch.column("dimension"), dimension))
                cells = plan.cells(_unit(np.stack([np.frombuffer(x, "<f8") for x in rows.column("numbers").to_pylist()])))
                for table in range(plan.tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cells), table, np.int32)), pa.array(cells[:, table].copy()), *rows.columns],
                        ["table", "cell", *rows.schema.names],
                    )

    kinds = "digest binary, node long, copies long, dimension int, numbers binary"
    placed = distinct.mapInArrow(place, f"table int, cell long, {kinds}")
    cell = ["dimension", "table", "cell"]
    # A cell that is too large is cut into parts; every two parts meet in a task of their own.
    sizes = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > largest)
    sizes = staged(sizes.select(*cell, F.ceil(F.col("size") / largest).cast("int").alias("parts")), "large_cells")
    parted = placed.join(sizes, cell, "left")
    part = F.pmod(F.xxhash64("digest"), F.col("parts").cast("long")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    meetings = F.transform(
        others,
        lambda other: F.struct(
            (F.least(part, other) * F.col("parts") + F.greatest(part, other)).alias("meeting"),
            F.when(part == other, 2).when(part < other, 0).otherwise(1).alias("side"),
        ),
    )
    alone = F.array(F.struct(F.lit(0).alias("meeting"), F.lit(2).alias("side")))
    met = parted.select(*cell, "digest", "node", "copies", "numbers", F.inline(F.when(F.col("parts").isNull(), alone).otherwise(meetings)))
    key = [*cell, "meeting"]
    together = met.repartition(*key).sortWithinPartitions(*key)

    def compare(batches):
        names = [*key, "digest", "node", "copies", "numbers", "side"]
        for dimension, table, rows in _groups(batches, key, names):
            found = list(_compare(rows, plans.value[dimension], table))
            if found:
                columns = zip(zip(*found), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["digest", "links", "node", "label"])

    found = staged(together.mapInArrow(compare, "digest binary, links long, node long, label long"), "links")
    linked = components(found.select("node", "label").distinct(), "node", "label")
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    classes = distinct.select("digest", "node", "copies").join(links, "digest", "left").join(linked, "node", "left")
    classes = classes.select(
        F.col("digest").alias("of"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component", "node").alias("component"),
    )
    rows = prepared.select("vec_id", "digest").join(classes, F.col("digest") == F.col("of"), "left")
    component = F.coalesce("component", "vec_id")
    return rows.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _groups(batches, key: list[str], names: list[str]) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """The rows of each key of a sorted stream; a key may go on in the next batch."""
    held: list[pa.RecordBatch] = []

    def columns(parts: list[pa.RecordBatch]) -> tuple[int, int, dict[str, np.ndarray]]:
        table = pa.Table.from_batches(parts)
        rows = {n: np.array(table.column(n).to_pylist(), object) if n in ("digest", "numbers") else table.column(n).to_numpy() for n in names}
        return int(rows["dimension"][0]), int(rows["table"][0]), rows

    def first_key(batch: pa.RecordBatch) -> tuple:
        return tuple(batch.column(k)[0].as_py() for k in key)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in key:
            values = batch.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            piece = batch.slice(a, b - a)
            if held and first_key(held[0]) != first_key(piece):
                yield columns(held)
                held = []
            held.append(piece)
    if held:
        yield columns(held)
