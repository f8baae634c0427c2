"""Language identification by rank-order profiles of character n-grams.

A text's letters are lower-cased and its n-grams of one to three characters counted, words being
bounded by blanks.  A profile is the list of the most frequent n-grams, the most frequent first.  The
out-of-place distance of a text from a language adds up, for each n-gram of the text's profile, how
many places apart its ranks are, or the full length of a profile where the language's profile lacks it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import LETTER, classes

RANKS = 300  # n-grams of a profile
SAMPLE = 3000  # documents per language that profiles are fitted on, on average
LANGUAGES = 1000  # at most so many are fitted unless the caller says otherwise
UNKNOWN = "und"
POINT = 21  # bits of a code point


@dataclass(frozen=True)
class Profiles:
    """Ranks by language and n-gram; `RANKS` where the profile lacks the n-gram."""

    languages: list[str]
    grams: np.ndarray  # sorted
    ranks: np.ndarray  # languages x grams

    def nearest(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        ranked = codes[np.lexsort((codes, -counts))[:RANKS]]
        place = np.minimum(np.searchsorted(self.grams, ranked), len(self.grams) - 1)
        known = self.grams[place] == ranked
        theirs = np.where(known, self.ranks[:, place], RANKS)
        apart = np.where(theirs == RANKS, RANKS, np.abs(theirs - np.arange(len(ranked))))
        distances = apart.sum(axis=1)
        best = int(distances.argmin())
        return self.languages[best], 1.0 - float(distances[best]) / (RANKS * len(ranked))


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text as numbers, sorted, and their counts."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letters = classes()[points] == LETTER
    if not letters.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.where(letters, points, ord(" "))
    points = np.concatenate([[ord(" ")], points, [ord(" ")]])
    letters = np.concatenate([[False], letters, [False]])
    kept = letters | np.append(True, letters[:-1])  # of several blanks, the first
    points, letters = points[kept], letters[kept]
    pairs = points[:-1] << POINT | points[1:]
    triples = (pairs[:-1] << POINT | points[2:])[letters[1:-1]]
    return np.unique(np.concatenate([points[letters], pairs, triples]), return_counts=True)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; also those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, label: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES) -> Profiles:
    """Profiles from documents with text and label that are not held out.

    From each language about `sample` documents are taken, by a hash of their ids, so that fitting
    takes the same time for any number of documents.  N-grams are counted by Spark; the driver gets
    `RANKS` rows per language.  Of more labels than `languages`, which bounds what driver and tasks hold,
    the most frequent are learned, and documents of others go to the nearest of these.  Without labelled rows there are no languages, and every text is
    unknown.
    """
    rows = docs.select("doc_id", F.col("text").cast("string"), F.col(label).cast("string").alias("lang"))
    rows = rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not sizes:
        return Profiles([], np.empty(0, np.int64), np.empty((0, 0), np.int64))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["count"])))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1_000_000)) / 1_000_000
    chosen = rows.filter(draw < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in batches:
            by_language: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_language.setdefault(lang, []).append(ngrams(text))
            for lang, found in by_language.items():
                codes, places = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                counts = np.bincount(places, np.concatenate([n for _, n in found]), len(codes)).astype("int64")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])

    counted = chosen.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < RANKS)
    found = top.select("lang", "gram", "rank").collect()
    languages = sorted({r["lang"] for r in found})
    grams = np.array(sorted({r["gram"] for r in found}), np.int64)
    ranks = np.full((len(languages), len(grams)), RANKS, np.int64)
    for r in found:
        ranks[languages.index(r["lang"]), np.searchsorted(grams, r["gram"])] = r["rank"]
    return Profiles(languages, grams, ranks)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred`, `score` for every whole text.

    `score` is 1 less the distance as a share of the largest possible one.  A text that is null or has
    no letter is `und` with score 0; ties go to the language first in order.  Rows are taken one by
    one: repeated ones come out repeatedly, a null id stays null.  Other columns are not looked at.
    """

    def run(batches):
        for batch in batches:
            found = [profiles.nearest(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    kind = dict(docs.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def in_known_language(docs: DataFrame, profiles: Profiles, least: float) -> DataFrame:
    """The rows, unchanged, whose text has a language, with a score of at least `least`."""

    def run(batches):
        for batch in batches:
            found = [profiles.nearest(text) for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
