import math
import random

import numpy as np
import plain
import pytest

from skyledger.llm import lexical_search as ls


def brute_force(docs, items, depth=50):
    """(item, rank, doc_id, score) of the contract; `items` maps ids to texts."""
    words = [(i, plain.benchmark_words(t)) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, total = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for term in set(w):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, texts in items.items():
        terms = {t for text in texts for t in plain.benchmark_words(text)}
        scored = []
        for i, w in words:
            m = 100 - 50 + 50 * len(w) * n_docs // total
            score = sum(
                int(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m))
                for t in terms & set(w)
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:depth])]
    return out


def corpus(seed, docs=300):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    share = [1 / (k + 1) for k in range(400)]
    say = lambda n: " ".join(rng.choices(vocabulary, share, k=n))
    texts = [say(rng.choice([1, 5, 40, 40, 300])) for _ in range(docs)]
    items = {k: [say(rng.choice([1, 2, 8, 30]))] for k in range(25)}
    for k in range(10):
        texts[k] += " " + items[k][0].upper()
    return texts, items


def rows(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("seed,shard,depth,block", [(1, ls.SHARD, 50, ls.BLOCK), (2, 3000, 7, 300), (3, 1, 50, ls.BLOCK)])
def test_against_brute_force(spark, clashing, seed, shard, depth, block):
    texts, items = corpus(seed)
    docs = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(11, texts[11]), (12, None), (13, ""), (14, "...")]
    asked = {**items, 100: ["w1 unknown", "w2 w2 w3"], 101: ["unheard"], None: ["w5 w6"]}
    listed = [(i, t) for i, ts in asked.items() for t in ts] + [(100, None), (102, "")] + [(0, items[0][0])] * 3
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in listed], "item_id long, text string, doc_id string").repartition(4)
    index = ls.build_index(clashing(*docs), shard)
    got = rows(ls.search(index, benchmark, depth, block))
    want = brute_force(docs, asked, depth)
    assert got == sorted(want, key=str) and len(got) > 100


def test_ties_go_by_id(spark, documents):
    docs = documents(*[(i, "same words here") for i in random.Random(1).sample(range(200), 120)], (None, "same words here"), (500, "other"))
    index = ls.build_index(docs.repartition(5), 100)
    got = rows(ls.search(index, spark.createDataFrame([("a", "words")], "item_id string, text string")))
    ids = [i for _, _, i, _ in sorted(got, key=lambda r: r[1])]
    assert len(ids) == 50 and ids == sorted(ids)


def test_nothing_to_search(spark, documents):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert ls.search(ls.build_index(documents()), items).collect() == []
    assert ls.search(ls.build_index(documents((1, None), (2, ""))), items).collect() == []
    index = ls.build_index(documents((1, "a")))
    assert ls.search(index, none).collect() == []
    assert ls.search(index, items).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def _shard(terms):
    """A shard from term -> {place: impact}, and the pairs (0, 1), (2, 3) of its one query."""
    lists = {t: (np.array(sorted(p)), np.array([p[k] for k in sorted(p)]), max(p.values())) for t, p in terms.items()}
    met = {}
    for pair, (a, b) in enumerate([(0, 1), (2, 3)]):
        both = sorted(set(terms[a]) & set(terms[b]))
        joint = np.array([terms[a][k] + terms[b][k] for k in both], np.int64)
        met[pair] = (np.array(both, np.int64), joint, int(joint.max(initial=0)))
    return ls.Shard(1000, lists, met), ls.Pairs(np.array([(0, 1), (2, 3)]), [(np.array([0, 1]), None)])


def test_pair_bounds_skip_more():
    """Two frequent terms that never meet: no document gets more than the larger of the two."""
    terms = {0: {k: 60 for k in range(0, 400)}, 1: {k: 50 for k in range(400, 800)}, 2: {900: 90}, 3: {901: 80, 900: 1}}
    shard, pairs = _shard(terms)
    assert [bound for bound, _ in shard.units(pairs, 0)] == [60, 91]
    places, scores = shard.search(pairs, 0, 91)
    assert list(zip(places.tolist(), scores.tolist())) == [(900, 91)]
    assert shard.touched < 10
    # With the sums of single maxima instead, the lists of both are read.
    loose, _ = _shard(terms)
    loose.pairs = {0: (loose.pairs[0][0], loose.pairs[0][1], 110), 1: (loose.pairs[1][0], loose.pairs[1][1], 170)}
    again = loose.search(pairs, 0, 91)
    assert again[0].tolist() == [900] and loose.touched >= 800
    # And a shard that can not reach the score is skipped whole.
    assert not len(shard.search(pairs, 0, 152)[0])


def test_search_of_a_shard_against_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        terms = {t: {rng.randrange(30): rng.randint(1, 50) for _ in range(rng.randint(1, 20))} for t in range(4)}
        shard, pairs = _shard(terms)
        shard.size = 30
        total = {k: sum(p.get(k, 0) for p in terms.values()) for k in range(30)}
        least = rng.choice([0, 1, 40, 80, 120])
        places, scores = shard.search(pairs, 0, least)
        assert dict(zip(places.tolist(), scores.tolist())) == {k: s for k, s in total.items() if s >= max(1, least)}
        depth = rng.randint(1, 6)
        seed = shard.seed(pairs, 0, depth)
        assert sum(s >= seed for s in total.values()) >= depth or seed == 0


def test_one_shard_at_a_time(spark, documents, monkeypatch):
    """Tasks of many shards hold one of them: in the file, and on the way to Python."""
    from pyarrow import parquet

    def groups(frame):
        files = [parquet.ParquetFile(f.removeprefix("file://")) for f in frame.inputFiles()]
        return [f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]

    name, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, ls.staged
    before = spark.conf.get(name)

    def spy(rows, table, **more):
        seen[table] = (spark.conf.get(name), done := write(rows, table, **more))
        return done

    monkeypatch.setattr(ls, "staged", spy)
    index = ls.build_index(documents(*[(i, f"w{i} w{i % 3}") for i in range(30)]).coalesce(1), 1)
    items = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert len(rows(ls.search(index, items))) == 20
    assert groups(index) == groups(seen["lexical-impacts"][1]) == [1] * 30
    assert seen["lexical-impacts"][0] == seen["lexical-found"][0] == "1"
    assert spark.conf.get(name) == before
