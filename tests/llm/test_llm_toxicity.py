import random
import zlib
from collections import Counter

import numpy as np
import pytest

from skyledger.llm import toxicity

VILE = ["idiot", "scum", "loser", "grrrk"]


def corpus(n=600):
    """Texts, some of which hold vile words, a fiftieth of the words and more."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(["ka", "lo", "mi", "tu", "re", "no"], k=rng.randint(1, 4))) for _ in range(rng.choice([10, 60, 400]))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(1 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(VILE))
        rows.append((i, " ".join(words).title() if i % 3 else ", ".join(words), toxic))
    return rows


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))


def test_held_out_documents(clashing, model):
    rows = corpus()
    got = {r["doc_id"]: r for r in toxicity.score(clashing(*[r[:2] for r in rows]), model).collect()}
    for i, _, toxic in rows:
        assert got[i]["held_out"] == held_out(i)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    held = [(got[i]["predicted"], toxic) for i, _, toxic in rows if held_out(i)]
    assert sum(t for _, t in held) > 15
    assert sum(p == t for p, t in held) >= 0.97 * len(held)


def test_labels_of_held_out_documents_are_not_learned(spark):
    """Turning the labels of held-out documents round, or adding rows without id or label, changes nothing."""
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    turned = [(i, 1 - y if held_out(i) else y) for i, _, y in rows] + [(None, 1), (5000, None), (5001, 7)]
    a = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = toxicity.fit(docs, spark.createDataFrame(turned, "doc_id long, toxic int"))
    assert [a.score(t) for _, t, _ in rows[:40]] == pytest.approx([b.score(t) for _, t, _ in rows[:40]], abs=1e-6)


def test_ngrams_against_brute_force():
    for text in ["a", "Ab-c", "  one  two, Three ", "ÄÖ 12 ü", "x" * 9, "", "12 %", None]:
        clean = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        want = Counter()
        for word in clean.split():
            bounded = f" {word} "
            want.update(bounded[i : i + n] for n in toxicity.SIZES for i in range(len(bounded) - n + 1))
        got = Counter(toxicity.ngrams(text).tolist())
        assert sorted(got.values()) == sorted(want.values())
    assert set(toxicity.ngrams("one").tolist()) < set(toxicity.ngrams("two one").tolist())


def test_counts_and_evidence_against_brute_force(spark):
    texts = [(0, "aa bb"), (0, "bb"), (1, "cc cc cc"), (1, "bb cc"), (0, None)]
    rows = spark.createDataFrame(texts, "label int, text string").repartition(3)
    want = np.zeros((4, 1 << toxicity.BITS), np.int64)
    for label, text in texts:
        found = toxicity.ngrams(text).tolist()
        for bucket, times in Counter(found).items():
            want[label, bucket] += 1
            want[2 + label, bucket] += 1_000_000 * times // len(found)
    got = {r[0]: tuple(r)[1:] for r in toxicity._counts(rows).collect()}
    assert got == {int(b): tuple(want[:, b].tolist()) for b in np.flatnonzero(want.any(axis=0))}
    frame = spark.createDataFrame([(10, 0), (0, 10), (5, 5), (10, 10)], "clean long, toxic long")
    from pyspark.sql import functions as F

    told = [r[0] for r in frame.select(toxicity._evidence(F.col("clean"), F.col("toxic"), 10, 10)).collect()]
    assert told[0] == told[1] == pytest.approx(20 * np.log(2)) and told[2:] == pytest.approx([0, 0])


def test_cases(documents, model):
    rows = [(1, None), (2, ""), (3, "12 % \n"), (None, "ka lo"), (None, "ka lo"), (4, "idiot " * 100_000), (5, "ka lo mi " * 100_000)]
    got = sorted(((r["doc_id"], r["predicted"], r["held_out"]) for r in toxicity.score(documents(*rows), model).collect()), key=str)
    known = {i: p for i, p, _ in got}
    assert [known[i] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 0]
    assert [g for g in got if g[0] is None] == [(None, 0, True)] * 2
    assert toxicity.score(documents(), model).collect() == []


def test_nothing_to_learn_from(spark, documents):
    docs = documents((1, "ka lo"), (2, "idiot"), (3, None))
    labels = lambda *rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels())).collect()] == [0.0] * 3
    assert [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels((2, 1), (1, 1)))).collect()] == [1.0] * 3
    assert [r["score"] for r in toxicity.score(docs, toxicity.fit(documents(), labels((2, 1), (1, 0)))).collect()] == [0.0] * 3


def test_repeated_rows_count_once(spark, documents):
    docs = documents(*[(1, "ka lo")] * 50, (2, "idiot"), (2, "idiot"), (2, None))
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0)], "doc_id long, toxic int")
    sampled = sorted(map(tuple, toxicity._sample(docs, labels, "toxic", 10).collect()))
    assert sampled == [(0, "ka lo"), (1, "idiot")]
