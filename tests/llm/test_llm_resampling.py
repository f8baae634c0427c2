import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import plain
import pytest

from skyledger.llm import resampling as rs


def features(text, longest):
    words = plain.benchmark_words(text)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_force(docs, target, longest, buckets, share=10, least=20):
    """doc_id -> features, weight, score, rank; for distinct ids."""
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(of(f) for _, t in docs for f in features(t, longest))
    t = Counter(of(f) for text in target for f in features(text, longest))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out, able = {}, []
    for i, text in docs:
        found = features(text, longest)
        weight = sum(gain(of(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(found), weight, score, None]
        if len(plain.benchmark_words(text)) >= least:
            able.append((-score, i is None, i or 0, i))
    for rank, (*_, i) in enumerate(sorted(able)[: share * len(able) // 100]):
        out[i][3] = rank + 1
    return {i: tuple(r) for i, r in out.items()}


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choices(["The", "of", "rain", "é", "7", "in-spain", "Plain"], k=n))
    docs = [(i, say(rng.choice([0, 3, 19, 20, 21, 60, 300]))) for i in range(300)] + [(400, None), (401, "..."), (None, say(40))]
    return docs, [say(30) + " rain rain" for _ in range(5)] + [None]


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (2, 50), (3, 7)])
def test_against_brute_force(spark, clashing, longest, buckets):
    docs, target = corpus(longest)
    benchmark = spark.createDataFrame([(t,) for t in target], "text string")
    got = rs.resample(clashing(*docs).repartition(5), benchmark, longest, buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute_force(docs, target, longest, buckets)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    ranks = sorted(r[3] for r in want.values() if r[3])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 10


def test_crc_of_all_lengths():
    made = [os.urandom(n % 40) for n in range(2000)]
    assert rs.crc32(made).tolist() == [zlib.crc32(m) for m in made]
    assert rs.crc32([]).tolist() == []


def test_repeated_rows_are_ranked_one_by_one(spark, documents):
    """A row that makes up a third of the table spreads over ranges; its ranks follow one another."""
    text = " ".join(f"w{k}" for k in range(30))
    docs = documents(*[(7, text)] * 3000, *[(i, text + f" x{i}") for i in range(10_000, 16_000)]).repartition(6)
    weighted = rs.weights(docs, np.zeros(100, np.int64))
    got = rs.ranked(weighted, share=100).collect()
    ranks = sorted(r["rank"] for r in got)
    assert ranks == list(range(1, 9001))
    same = sorted(r["rank"] for r in got if r["doc_id"] == 7)
    assert same[-1] - same[0] == 2999
    by_rank = sorted((r["rank"], -r["score"]) for r in got)
    assert [s for _, s in by_rank] == sorted(s for _, s in by_rank)


def test_draw_keeps_rows(spark, clashing):
    docs, target = corpus(9)
    frame = clashing(*docs, (5, "again"))
    ranks = rs.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    chosen = {r["doc_id"] for r in ranks.filter("rank is not null").collect()} - {None}
    kept = rs.drawn(frame, ranks)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == chosen


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "text string")
    assert rs.resample(documents(), none).collect() == []
    text = "a " * 25
    got = rs.resample(documents((1, text)), none).first()
    assert tuple(got)[:2] == (1, 25) and got["rank"] is None
