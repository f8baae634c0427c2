import random

import numpy as np
import plain
import pytest

from skyledger.llm import decontamination as dc

WORDS = ["the", "of", "Rain", "in", "spain", "é", "7", "falls", "on", "plain"]


def corpus(seed):
    random.seed(seed)
    say = lambda n: [random.choice(WORDS) for _ in range(n)]
    items = [(str(i), " ".join(say(random.choice([1, 2, 5, 12, 13, 14, 30, 60])) + [f"u{i}"])) for i in range(25)]
    items += [("100", items[3][1]), ("3", "another text of the item with that number"), ("50", ""), ("51", None), ("52", "solo")]
    texts = ["", None, "...", "solo", "a solo b", " ".join(say(400))]
    for _ in range(60):
        words = say(random.randint(0, 300))
        for _ in range(random.randint(0, 2)):
            item = (random.choice(items)[1] or "").split()
            cut = random.randint(0, 3)
            words[len(words) // 2 : len(words) // 2] = item[cut : len(item) - random.randint(0, 2)]
        texts.append(random.choice([" ", ", ", " -- "]).join(words).upper() if random.random() < 0.3 else "\n".join(words))
    return texts, items


def found(texts, items, batch):
    tests = dc.Tests.of([(n, t.encode() if t else t) for n, t in items if t is not None])
    out = []
    for start in range(0, len(texts), batch):
        part = [t.encode() if t is not None else None for t in texts[start : start + batch]]
        shard = dc.Shard(part, tests)
        cover, names = shard.hits(tests)
        for k, size in enumerate(shard.sizes.tolist()):
            hit = int(cover[shard.starts[k] : shard.starts[k] + size].sum())
            out.append((size, hit, sorted(names[k]), dc.contaminated(size, hit)))
    return out


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_against_brute_force(batch):
    texts, items = corpus(batch)
    want = plain.contamination(texts, items)
    assert found(texts, items, batch) == want
    assert any(w[3] for w in want) and not all(w[3] for w in want)


def test_suffixes_are_sorted():
    texts, items = corpus(5)
    tests = dc.Tests.of([(n, t.encode()) for n, t in items if t])
    shard = dc.Shard([t.encode() if t else None for t in texts], tests)
    depth = max(len(t.split()) for _, t in items if t)
    suffixes = []
    for place in shard.suffixes.tolist():
        suffix = shard.words[place : place + depth].tolist()
        suffixes.append(suffix[: suffix.index(0)] if 0 in suffix else suffix)
    assert suffixes == sorted(suffixes)


def rows(result):
    return sorted(map(str, map(tuple, result.collect())))


def test_report_in_one_and_in_several_blocks(spark, clashing):
    texts, items = corpus(2)
    docs = clashing(*[(i if i % 9 else None, t) for i, t in enumerate(texts)], (3, texts[3]))
    benchmark = spark.createDataFrame([(int(n), t) for n, t in items] + [(None, texts[8])], "item_id long, text string")
    whole = dc.report(docs, benchmark)
    want = plain.contamination([*texts, texts[3]], [*items, ("", texts[8])])
    ids = [*(i if i % 9 else None for i in range(len(texts))), 3]
    assert rows(whole) == sorted(str((i, w, h, len(n), plain.sha(",".join(n)), c)) for i, (w, h, n, c) in zip(ids, want))
    assert rows(dc.report(docs, benchmark, block=200)) == rows(whole)
    clean = dc.cleaned(docs, benchmark)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not c for *_, c in want)


def test_blocks_are_held_one_at_a_time(spark, documents, monkeypatch):
    """Repeated items count once, so an item that most rows are copies of makes no large block."""
    texts, items = corpus(4)
    listed = [(int(n), t) for n, t in items] + [(7, items[7][1])] * 500
    benchmark = spark.createDataFrame(listed, "item_id long, text string")
    sizes, of = [], dc.Tests.of
    monkeypatch.setattr(dc.Tests, "of", lambda rows: sizes.append(len(rows)) or of(rows))
    docs = documents(*enumerate(texts))
    whole = rows(dc.report(docs, benchmark))
    assert sizes == [len({i for i in listed if i[1] is not None})]
    sizes.clear()
    held = []
    broadcast = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: held.append(b := broadcast(v)) or b)
    assert rows(dc.report(docs, benchmark, block=300)) == whole
    assert len(sizes) > 5 and len(held) == len(sizes)
    assert [c[0] for c in rows(dc.cleaned(docs, benchmark, block=300))] == [c[0] for c in rows(dc.cleaned(docs, benchmark))]


def test_longest_matches(spark, documents):
    docs = documents((1, "x one two three four y"), (2, "one two three zz"), (3, "five six"), (None, "six seven"))
    benchmark = spark.createDataFrame([(7, "one two three four five six seven")], "item_id long, text string")
    got = {r["offset"]: (r["length"], r["doc_id"], r["position"]) for r in dc.longest_matches(docs, benchmark).collect()}
    assert got == {0: (4, 1, 1), 1: (3, 1, 2), 2: (2, 1, 3), 4: (2, 3, 0), 5: (2, None, 0)}


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.report(documents(), none).collect() == []
    assert [r["contaminated"] for r in dc.report(documents((1, "some text")), none).collect()] == [False]
    one = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert dc.report(documents(), one).collect() == []
    assert [r["n_hit"] for r in dc.report(documents((1, "some text")), one).collect()] == [2]


def test_words():
    assert dc.words_of("It's A-1 é÷x\x00_Z".encode()) == [w.encode() for w in ("it", "s", "a", "1", "é÷x", "z")]
    assert np.array_equal(dc.Tests.of([("a", b"one word"), ("b", b"")]).need, [2, 0])
