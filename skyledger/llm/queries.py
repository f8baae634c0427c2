"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import bpe, chat, decontamination, embedding_dedup, language, lexical_search, line_dedup, resampling, secrets, simhash, substring_dedup, toxicity, warc
from skyledger.llm.checks import CHECKS as CHECKS
from skyledger.llm.common import read
from skyledger.session import work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_embedding_near_dedup(spark, folder):
    return embedding_dedup.near_duplicates(read(spark, folder, "embeddings"))


@query
def op2_simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(read(spark, folder, "documents"))


@query
def op3_bpe_round_trip(spark, folder):
    return bpe.round_trip(read(spark, folder, "documents"), TOKENIZER)


@query
def op4_secret_scan(spark, folder):
    docs = read(spark, folder, "documents")
    return secrets.report(secrets.find(docs, secrets.train(docs)))


@query
def op5_benchmark_decontamination(spark, folder):
    return decontamination.report(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def op6_warc(spark, folder):
    archive = warc.write_archive(read(spark, folder, "pages"), work_folder(spark, "archive"))
    return warc.read_archive(archive).drop("url")


@query
def op7_substring_dedup(spark, folder):
    return substring_dedup.report(read(spark, folder, "documents"))


@query
def op8_language_id(spark, folder):
    docs = read(spark, folder, "documents")
    return language.identify(docs, language.fit(docs))


@query
def op9_preference_format(spark, folder):
    pairs = chat.preference_pairs(*chat.degraded(read(spark, folder, "conversations")))
    return pairs.withColumns({c: chat.spans(pairs[c]) for c in ("chosen_mask", "rejected_mask")})


@query
def op10_line_dedup(spark, folder):
    return line_dedup.report(read(spark, folder, "documents"))


@query
def op11_toxicity(spark, folder):
    docs = read(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, folder, "labels")))


@query
def op12_lexical_search(spark, folder):
    return lexical_search.search(lexical_search.build_index(read(spark, folder, "documents")), read(spark, folder, "benchmark"))


@query
def op13_importance_resampling(spark, folder):
    return resampling.resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
