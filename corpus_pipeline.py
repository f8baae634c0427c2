"""The cleaning of a corpus: stages over the columns of `documents`, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import bpe, decontamination, language, line_dedup, simhash
from skyledger.llm.common import read, staged
from skyledger.llm.queries import TOKENIZER

# A text whose n-grams lie that far from every language, as one in an unknown script, has none.
LEAST_SCORE = 0.02


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in a known language; texts without letters go, null and empty ones among them."""
    return language.in_known_language(docs, language.fit(docs), LEAST_SCORE)


def drop_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without lines that a document with a smaller id holds; `n_chars` follows the text."""
    kept = line_dedup.deduplicated(docs, line_dedup.index_of(docs).losses())
    if "n_chars" not in kept.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near-duplicates one row, that with the smallest id; see `simhash.representatives`."""
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in windows of the benchmark."""
    return decontamination.cleaned(docs, read(spark, folder, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """`doc_id`, `n_tokens`, `ids_sha256`, `decoded_sha256` of what is left."""
    return bpe.round_trip(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

# Byte-pair merging and rank-order profiles are beyond SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last stage for `documents` in `folder`."""
    docs = read(spark, folder, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, folder), name)
    return docs
