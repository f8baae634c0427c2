import random

import plain
import pytest

from skyledger.llm import simhash

WORDS = [f"word{i}" for i in range(400)]


def corpus():
    random.seed(3)
    docs = {}
    for i in range(60):
        docs[3 * i] = " ".join(random.choice(WORDS) for _ in range(random.choice([1, 2, 3, 50, 300])))
    for i in range(40):  # near and exact copies
        words = docs[3 * (i % 25)].split()
        if i % 2:
            words[random.randrange(len(words))] = "other"
        docs[1000 - i] = "  ".join(words).upper() if i % 5 else "\t".join(words)
    docs |= {2000: "", 2001: " \n\t ", 2002: None, 2003: "\x00", 2004: "é É", 2005: "É é"}
    return docs


def as_rows(result):
    return {r["doc_id"]: (r["fingerprint"], r["component_id"], r["kept"]) for r in result.collect()}


def test_against_brute_force(documents):
    docs = corpus()
    want = plain.simhash_classes(docs)
    got = as_rows(simhash.near_duplicates(documents(*docs.items())))
    assert got == {i: (f"{plain.fingerprint(t):016x}", want[i], want[i] == i) for i, t in docs.items()}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_connect_a_chain(spark, radius):
    """Fingerprints that are reached only over others."""
    random.seed(radius)
    bits = {random.getrandbits(63) for _ in range(30)}
    for start in list(bits)[:10]:
        for _ in range(5):
            for _ in range(radius):
                start ^= 1 << random.randrange(63)
            bits.add(start)
    points = [(n, b) for n, b in enumerate(sorted(bits))]
    want = plain.classes([n for n, _ in points], [(a, c) for a, x in points for c, y in points if a < c and (x ^ y).bit_count() <= radius])
    links = simhash.links(spark.createDataFrame(points, "node long, bits long"), radius)
    got = plain.classes([n for n, _ in points], [(r["node"], r["other"]) for r in links.collect()])
    assert got == want


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "node long, bits long"), 3)


def test_the_half_ball_has_65_words():
    assert len(set(simhash.ball(1))) == 65


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 997}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text.encode()) == whole
    assert whole % (1 << 64) == plain.fingerprint(text)


def test_no_ids_repeated_rows_and_clashing_names(clashing):
    rows = [(5, "one two three four"), (5, "one two three four"), (None, "one two three four"), (None, "nothing like that at all"), (7, "ONE two three four")]
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in simhash.near_duplicates(clashing(*rows)).collect())
    assert got == [("5", "5", True), ("5", "5", True), ("7", "5", False), ("None", "5", False), ("None", "None", True)]


def test_empty_table(documents):
    assert simhash.near_duplicates(documents()).collect() == []


A, B, C = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")


@pytest.mark.parametrize(
    "rows,kept",
    [
        ([(1, A), (5, A), (5, B)], [(1, A), (5, B)]),
        ([(1, A), (1, A)], [(1, A)]),
        ([(1, A), (None, A)], [(1, A)]),
        ([(None, A), (None, A), (None, B)], [(None, A), (None, B)]),
        ([(3, None), (2, ""), (4, " "), (None, None)], [(2, "")]),
        ([(1, A), (1, B), (2, B), (2, C)], [(1, A), (1, B), (2, C)]),
        ([], []),
    ],
)
def test_one_row_of_each_group_stays(clashing, rows, kept):
    docs = clashing(*rows)
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(kept, key=str)


def test_rows_that_stay_against_brute_force(documents):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(50)}" for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(120):
        words = list(rng.choice(base))
        if rng.random() < 0.5:
            words[rng.randrange(60)] = "x"
        rows.append((i, " ".join(words)))
    classes = plain.simhash_classes(dict(rows))
    got = {r["doc_id"] for r in simhash.representatives(documents(*rows)).collect()}
    assert got == {i for i, c in classes.items() if i == c} and len(got) < 120
