"""The pipeline, stage by stage, against plain Python, and the registered queries."""

import hashlib
import os
import random
import zlib

import numpy as np
import plain
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from skyledger.llm import common, language, queries

FOLDER = "/root/testdata/sf0.001"
HERE = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
NAMES = sorted(queries.QUERIES, key=lambda n: (len(n.split("_")[0]), n))


def folder_of(spark, path):
    """Small tables with copies, shared lines, benchmark passages, and texts without language."""
    docs = [r for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()][:120]
    benchmark = pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()
    random.seed(1)
    for k in range(40):
        text = docs[k]["text"]
        made = [text, text + " more", "12345 67", None, "", "% % %", benchmark[k]["text"], f"{text[:300]} {benchmark[k]['text']}"][k % 8]
        docs.append({"doc_id": 5000 + k, "text": made, "lang": docs[k]["lang"], "source": None, "n_chars": len(made) if made is not None else None})
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame([tuple(d[c] for c in columns) for d in docs], kind).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(b["item_id"], b["text"]) for b in benchmark], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, benchmark


@HERE
def test_each_stage(spark, tmp_path):
    folder = str(tmp_path)
    docs, benchmark = folder_of(spark, folder)
    stage = dict(corpus_pipeline.STAGES)
    frame = common.read(spark, folder, "documents")
    columns = frame.columns
    profiles = language.fit(frame)

    def applied(name, before):
        after = common.staged(stage[name](spark, before, folder), name)
        return after, {r["doc_id"]: r.asDict() for r in after.collect()}

    frame, kept = applied("language_id", frame)
    assert frame.columns == columns
    want = {d["doc_id"]: d for d in docs if profiles.nearest(d["text"])[1] >= corpus_pipeline.LEAST_SCORE}
    assert kept == want
    assert len(docs) - len(kept) == 20  # those without letters

    frame, kept = applied("line_dedup", frame)
    lines = plain.line_dedup({i: d["text"] for i, d in want.items()})
    want = {i: d | {"text": lines[i][0], "n_chars": len(lines[i][0])} for i, d in want.items()}
    assert kept == want and frame.columns == columns

    frame, kept = applied("simhash_near_dedup", frame)
    classes = plain.simhash_classes({i: d["text"] for i, d in want.items()})
    fewer = {i: d for i, d in want.items() if classes[i] == i}
    assert kept == fewer and frame.columns == columns and len(fewer) < len(want)

    frame, kept = applied("benchmark_decontamination", frame)
    verdicts = plain.contamination([d["text"] for d in fewer.values()], [(str(b["item_id"]), b["text"]) for b in benchmark])
    clean = {i: d for (i, d), verdict in zip(fewer.items(), verdicts) if not verdict[3]}
    assert kept == clean and frame.columns == columns and len(clean) < len(fewer)

    _, encoded = applied("bpe_encoding", frame)
    library = Tokenizer.from_file(queries.TOKENIZER)
    for i, d in clean.items():
        ids = library.encode(d["text"], add_special_tokens=False).ids
        assert encoded[i]["n_tokens"] == len(ids)
        assert encoded[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert encoded[i]["decoded_sha256"] == plain.sha(d["text"])
    assert set(encoded) == set(clean)
    whole = {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == encoded


def test_stages_on_an_empty_table(spark, tmp_path, documents):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = documents()
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.count() == 0, name


def test_stages_keep_further_columns(spark, tmp_path, clashing):
    spark.createDataFrame([(1, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "the house of the man with the long name and the other one"
    frame = clashing((2, text), (1, text), (None, text), (3, "and now to something of the other kind that is no copy"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, str(tmp_path))
        assert after.columns == frame.columns
        frame = common.staged(after, "stage")
    assert sorted(map(str, (r["doc_id"] for r in frame.select("doc_id").collect()))) == ["1", "2", "3"]



@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    chain = [(k, k + 1) for k in range(1000, 1000 + 40)] if seed == 1 else []
    star = [(7, 2000 + k) for k in range(200)]
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(60)] + chain + star + [(5, 5)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = plain.classes({x for e in edges for x in e}, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: c for i, c in want.items() if i in linked}
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_all_operators_and_the_pipeline():
    assert [n.split("_")[0] for n in NAMES] == ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13", "pipeline"]
    assert set(queries.CHECKS) < set(queries.QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.fixture(scope="module")
def given_rows():
    return {r["doc_id"]: r for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}


def rows_of(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, FOLDER).collect()}


@HERE
def test_rows_of_op2(spark, given_rows):
    got = rows_of(spark, "op2_simhash_near_dedup")
    want = plain.simhash_classes({i: r["text"] for i, r in given_rows.items()})
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["fingerprint"] == f"{plain.fingerprint(given_rows[i]['text']):016x}" for i, r in got.items())


@HERE
def test_rows_of_op3(spark, given_rows):
    model = Tokenizer.from_file(queries.TOKENIZER)
    model.no_truncation()
    model.no_padding()
    got = rows_of(spark, "op3_bpe_round_trip")
    assert set(got) == set(given_rows)
    for i, r in got.items():
        ids = model.encode(given_rows[i]["text"] or "", add_special_tokens=False).ids
        text = model.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), plain.sha(text)
        )


@HERE
def test_rows_of_op4(spark, given_rows):
    got = rows_of(spark, "op4_secret_scan")
    ratios = plain.markov_ratios([r["text"] for r in given_rows.values()])
    kinds = ("assign", "access", "hex", "random")
    for i, r in given_rows.items():
        base = plain.base_secrets(r["text"])
        added = [(s, 3, e) for s, e, ratio in plain.random_strings(r["text"], ratios) if ratio > np.log(1e6)]
        shown = lambda spans: ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
        assert (got[i]["base_sha256"], got[i]["spans"]) == (plain.sha(shown(base)), shown(sorted(base + added)))


@HERE
def test_rows_of_op8(spark, given_rows):
    got = rows_of(spark, "op8_language_id")
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in given_rows}
    learned = plain.languages([(r["text"], r["lang"]) for i, r in given_rows.items() if not held[i] and r["lang"] is not None])
    for i, r in given_rows.items():
        lang, score = plain.nearest(r["text"], learned)
        assert (got[i]["lang_pred"], got[i]["held_out"]) == (lang, held[i]) and abs(got[i]["score"] - score) < 1e-12


@HERE
@pytest.mark.parametrize("name", [n for n in NAMES if n not in queries.CHECKS])
def test_queries_beyond_sql(spark, name):
    """Those with SQL are compared with it by the test of all registered queries."""
    rows = queries.QUERIES[name](spark, FOLDER)
    assert rows.count() == 200 if name != "pipeline" else rows.count() > 150
