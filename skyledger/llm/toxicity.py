"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams of its characters, within words and their bounds, hashed to buckets; a
feature's value is the root of its share of the text, so that long texts do not weigh more than short ones.
From labelled texts each bucket gets its log-count ratio: how much more of toxic texts it makes up than of
others.  The buckets whose presence tells most about the label are kept, their values are scaled by the
ratio, and a logistic regression is fitted on that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import LETTER, classes, staged
from skyledger.llm.language import held_out
from skyledger.session import work_folder

SIZES = (3, 4, 5)  # characters of an n-gram
BITS = 20  # of a bucket
SAMPLE = 10_000  # documents of either label that the classifier is fitted on, at most
FEATURES = 1 << 13  # buckets that are kept
SMOOTHING = 0.01  # of the shares that texts of a label add up to
PENALTY = 3e-8  # of the regression, whose features are small: roots of shares times ratios
ITERATIONS = 100
BLANK = ord(" ")
PRIME = np.uint64(0x9E3779B97F4A7C15)  # odd; spreads code points over 64 bits


@dataclass(frozen=True)
class Model:
    """A weight per bucket, 0 where it is not kept, and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        found = ngrams(text)
        held, times = np.unique(found[self.weights[found] != 0], return_counts=True)
        margin = self.intercept + float(self.weights[held] @ np.sqrt(times / max(1, len(found))))
        return round(1.0 / (1.0 + float(np.exp(-np.clip(margin, -700, 700)))), 9)


def ngrams(text: str | None) -> np.ndarray:
    """The buckets of all n-grams of a whole text, repeats included."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = classes()[points] == LETTER
    if not letters.any():
        return np.empty(0, np.int64)
    points = np.concatenate([[BLANK], np.where(letters, points, BLANK), [BLANK]]).astype(np.uint64)
    letters = np.concatenate([[False], letters, [False]])
    kept = letters | np.append(True, letters[:-1])  # of several blanks, the first
    points, letters = points[kept], letters[kept]
    blanks = np.cumsum(~letters)
    hashed, found = points, []
    for size in range(2, min(max(SIZES), len(points)) + 1):
        hashed = (hashed[:-1] + np.uint64(1)) * PRIME ^ points[size - 1 :]
        if size in SIZES:
            # No blank but at the ends.
            inside = blanks[size - 2 : len(blanks) - 1] == blanks[: len(blanks) - size + 1]
            found.append(hashed[inside])
    return (np.concatenate(found) * PRIME >> np.uint64(64 - BITS)).astype(np.int64)


def _sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """`label`, `text` of at most `sample` documents of either label, chosen by a hash of their ids."""
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
        .filter(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    sides = [known.filter(F.col("label") == side).orderBy(draw, "doc_id").limit(sample) for side in (0, 1)]
    chosen = sides[0].union(sides[1])  # at most twice `sample` rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    found = texts.join(F.broadcast(chosen), "doc_id").filter("text is not null")
    # One text per document; copies of a row are combined before the shuffle.
    return found.groupBy("doc_id", "label").agg(F.max("text").alias("text")).select("label", "text")


def _counts(rows: DataFrame) -> DataFrame:
    """`bucket`, and for either label how many texts hold it and its shares of these texts, in millionths."""
    names = ["clean", "toxic", "clean_share", "toxic_share"]

    def run(batches):
        counts = np.zeros((4, 1 << BITS), np.int64)
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                found = ngrams(text)
                held, times = np.unique(found, return_counts=True)
                counts[label, held] += 1
                counts[label + 2, held] += 1_000_000 * times // max(1, len(found))
        seen = np.flatnonzero(counts[:2].any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(c[seen]) for c in counts)], ["bucket", *names])

    partial = rows.mapInArrow(run, "bucket bigint, " + ", ".join(f"{n} bigint" for n in names))
    return partial.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])


def _evidence(clean: Column, toxic: Column, n_clean: int, n_toxic: int) -> Column:
    """How far a bucket's counts are from independence of the label (G-squared, without the constant)."""
    both = clean + toxic

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = n_toxic / (n_clean + n_toxic)
    return (
        term(toxic, both * share)
        + term(clean, both * (1 - share))
        + term(n_toxic - toxic, (n_clean + n_toxic - both) * share)
        + term(n_clean - clean, (n_clean + n_toxic - both) * (1 - share))
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    sample: int = SAMPLE,
    features: int = FEATURES,
    penalty: float = PENALTY,
) -> Model:
    """A classifier learned from labelled documents that are not held out.

    It is fitted on at most `sample` documents with label 1 and as many with label 0, weighted by how
    many of each there are, so that a score is a share among labelled documents.  An id labelled both
    ways is toxic.  N-grams are counted by Spark and the regression runs in Spark; the driver gets one
    row per kept bucket.  With one label only, or none, all scores are that label's share, or 0.
    """
    spark = docs.sparkSession
    rows = staged(_sample(docs, labels, label, sample), "toxicity-sample")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return Model(np.zeros(1 << BITS), 700.0 if 1 in n else -700.0)
    known = labels.filter(~held_out(F.col("doc_id"))).groupBy(F.col(label).cast("int").alias("label")).count()
    whole = {r["label"]: r["count"] for r in known.filter(F.col("label").isin(0, 1)).collect()}
    top = (
        _counts(rows)
        .withColumn("evidence", _evidence(F.col("clean"), F.col("toxic"), n[0], n[1]))
        .orderBy(F.desc("evidence"), "bucket")
        .limit(features)
        .select("bucket", "clean_share", "toxic_share")
        .collect()
    )
    kept = np.array([r["bucket"] for r in top], np.int64)
    # Mean shares of the n-gram in texts of either label.
    p, q = ((np.array([r[f"{side}_share"] for r in top]) / 1e6 + SMOOTHING) / n[k] for k, side in ((1, "toxic"), (0, "clean")))
    ratio = np.log(p / q)
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def vectors(batches):
        for batch in batches:
            indices, values = [], []
            for text in batch.column("text").to_pylist():
                found = place[ngrams(text)]
                here, times = np.unique(found[found >= 0], return_counts=True)
                indices.append(here)
                values.append(ratio[here] * np.sqrt(times / max(1, len(found))))
            weight = [whole[k] / n[k] for k in batch.column("label").to_pylist()]
            ends = np.cumsum([0, *map(len, indices)]).astype(np.int32)
            sparse = pa.StructArray.from_arrays(
                [
                    pa.array([0] * len(indices), pa.int8()),
                    pa.array([len(kept)] * len(indices), pa.int32()),
                    pa.ListArray.from_arrays(ends, np.concatenate(indices).astype(np.int32)),
                    pa.ListArray.from_arrays(ends, np.concatenate(values)),
                ],
                ["type", "size", "indices", "values"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.float64()), pa.array(weight, pa.float64()), sparse], ["label", "weight", "features"]
            )

    kind = "type tinyint, size int, indices array<int>, values array<double>"
    path = work_folder(spark, "toxicity-features")
    rows.mapInArrow(vectors, f"label double, weight double, features struct<{kind}>").write.parquet(path)
    # The struct is how a sparse vector is stored.
    schema = T.StructType().add("label", "double").add("weight", "double").add("features", VectorUDT())
    regression = LogisticRegression(
        weightCol="weight", maxIter=ITERATIONS, regParam=penalty, standardization=False, aggregationDepth=2
    )
    fitted = regression.fit(spark.read.schema(schema).parquet(path))
    weights = np.zeros(1 << BITS)
    weights[kept] = fitted.coefficients.toArray() * ratio
    return Model(weights, float(fitted.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` for every whole text.

    A text without letters (null, empty, digits) has no features and gets the score of none.  Rows are
    taken one by one: repeated ones come out repeatedly, a null id stays null and counts as held out.
    Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.score(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    kind = dict(docs.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
