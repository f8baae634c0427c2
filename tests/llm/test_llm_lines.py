import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from skyledger.llm import line_dedup
from skyledger.llm.cuckoo import CuckooFilter


def corpus():
    random.seed(1)
    common = [f"A line that many documents hold, number {i}" for i in range(30)] + ["short", "exactly10c", "exactly 9", "ééééééééé", "éééééééééé"]
    docs = {}
    for i in range(80):
        lines = [random.choice(common) if random.random() < 0.5 else f"line {random.random()} of {i}" for _ in range(random.randint(0, 12))]
        docs[i * 7 % 101] = "\n".join(random.choice(["", "  ", "\t"]) + (x.upper() if random.random() < 0.2 else x) for x in lines)
    return docs | {500: None, 501: "", 502: "\n\n", 503: docs[7], 504: common[0] + "\r\n" + common[0]}


def kept(result):
    return {r["doc_id"]: (r["kept_sha256"], r["n_lines"], r["n_dropped"]) for r in result.collect()}


def wanted(docs):
    return {i: (plain.sha(text), n, gone) for i, (text, n, gone) in plain.line_dedup(docs).items()}


def test_against_brute_force(documents):
    docs = corpus()
    want = wanted(docs)
    assert sum(gone for _, _, gone in want.values()) > 50
    assert kept(line_dedup.report(documents(*docs.items()))) == want


def losses_of(index):
    return {r["doc_id"]: {(k["high"], k["low"]) for k in r["keys"]} for r in index.losses().collect()}


def test_insertions_and_deletions_are_reversible(documents):
    docs = corpus()
    ids = sorted(docs)
    all_of, first = documents(*docs.items()), documents(*[(i, docs[i]) for i in ids[::2]])
    late = [(i, docs[i]) for i in ids[1::2]]
    start = line_dedup.LineIndex.empty(1000).insert(first)
    both = start.insert(documents(*late))
    whole = line_dedup.LineIndex.empty(1000).insert(all_of)
    assert losses_of(both) == losses_of(whole)
    # Inserting again changes nothing; deleting brings the index before back.
    assert losses_of(both.insert(documents(*late[:5]))) == losses_of(both)
    back = both.delete(documents(*late))
    assert losses_of(back) == losses_of(start)
    same = lambda a, b: sorted(map(tuple, a.counts.select("high", "low", "refs", "first").collect())) == sorted(
        map(tuple, b.counts.select("high", "low", "refs", "first").collect())
    )
    assert same(back, start)
    # The filters know all keys that are left, and only few others.
    probed = back._probed(whole.counts).join(back.counts.select("high", "low", F.lit(True).alias("there")), ["high", "low"], "left")
    assert probed.filter("there and not maybe").count() == 0
    assert probed.filter("there is null and maybe").count() <= 3
    # Without the smallest holder of a line, the next one keeps it.
    smallest = min(i for i in ids if docs[i])
    rest = {i: t for i, t in docs.items() if i != smallest}
    assert losses_of(whole.delete(documents((smallest, "")))) == losses_of(line_dedup.LineIndex.empty(10).insert(documents(*rest.items())))
    assert losses_of(whole.delete(documents((99_999, "")))) == losses_of(whole)


def test_filters_grow_when_they_are_full(documents):
    index = line_dedup.LineIndex.empty(8).insert(documents((1, "a first line of some length")))
    many = documents((2, "\n".join(f"line number {i} of a long document" for i in range(5000))))
    grown = index.insert(many)
    assert grown._probed(grown.counts).filter("not maybe").count() == 0
    assert grown.counts.count() == 5001


def test_cases(clashing):
    line = "a line of more than ten characters"
    rows = [(3, line), (3, line), (1, f"{line}\nx"), (None, line), (2, None), (4, f" {line.upper()}\t")]
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"]) for r in line_dedup.report(clashing(*rows)).collect())
    assert got == [("1", 2, 0), ("2", 1, 0), ("3", 1, 1), ("3", 1, 1), ("4", 1, 1), ("None", 1, 0)]
    docs = clashing(*rows)
    texts = line_dedup.deduplicated(docs, line_dedup.index_of(docs).losses())
    assert texts.columns == docs.columns
    assert sorted(str(r["text"]) for r in texts.select("doc_id", "text").collect()) == sorted(["", "", f"{line}\nx", line, "None", ""])


def test_empty_table(documents):
    assert line_dedup.report(documents()).collect() == []


@pytest.mark.parametrize("n", [1, 100, 20_000])
def test_cuckoo_filter(n):
    random_ = np.random.default_rng(n)
    keys = random_.integers(-(2**63), 2**63 - 1, (2, n))
    others = random_.integers(-(2**63), 2**63 - 1, (2, 20_000))
    made = CuckooFilter.sized(n)
    assert made.add(*keys)
    assert made.contains(*keys).all()
    assert made.contains(*others).mean() < 0.001
    again = CuckooFilter.from_bytes(made.to_bytes())
    half = n // 2
    again.remove(keys[0][:half], keys[1][:half])
    assert again.contains(keys[0][half:], keys[1][half:]).all()
    assert len(again) == n - half
    assert not CuckooFilter.sized(16).add(*others)
