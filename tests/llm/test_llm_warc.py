import base64
import glob
import gzip
import hashlib
import os
import random

import numpy as np
import pytest

from skyledger.llm import warc

PAGES = "page_id long, url string, html string"


def corpus():
    random.seed(2)
    html = ["", None, "<p>é\r\n\r\nWARC/1.1</p>", "x" * 300_000] + [f"<p>{random.random()}</p>" * random.randint(1, 400) for _ in range(40)]
    return [(i * 37 % 1009 - 200, f"http://host{i % 3}/{i}" if i % 7 else None, random.choice(html)) for i in range(150)]


def wanted(rows):
    first = {}
    for page, _, html in rows:
        first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        content = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(content).digest()).decode()
        owner = first[html or ""]
        out.append((page, len(content), digest, "response" if owner == page else "revisit", None if owner == page else owner))
    return sorted(out)


def read(archive):
    rows = warc.read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted(map(tuple, rows), key=str)


def test_round_trip(spark, tmp_path):
    rows = corpus()
    pages = spark.createDataFrame(rows, PAGES)
    archive = warc.write_archive(pages, f"{tmp_path}/a", shard_bytes=200_000, file_bytes=20_000)
    assert read(archive) == sorted(wanted(rows), key=str)
    assert archive.manifest.count() > 3
    payloads = {r["page_id"]: r["payload"] for r in warc.read_archive(archive, payloads=True).collect()}
    for page, _, html in rows:
        assert payloads[page] in (None, bytearray((html or "").encode()))
    assert not glob.glob(f"{tmp_path}/a/_temporary/*")


def test_files_are_the_same_for_any_partitioning(spark, tmp_path):
    rows = corpus()
    contents = []
    for name, shuffled in (("a", 1), ("b", 5)):
        random.Random(shuffled).shuffle(rows)
        pages = spark.createDataFrame(rows, PAGES).repartition(shuffled)
        warc.write_archive(pages, f"{tmp_path}/{name}", shard_bytes=200_000, file_bytes=20_000)
        contents.append({os.path.basename(p): open(p, "rb").read() for p in glob.glob(f"{tmp_path}/{name}/*.warc.gz")})
    assert contents[0] == contents[1]
    # Every record is a member of its own, and files are rolled by their compressed size.
    for content in contents[0].values():
        assert gzip.decompress(content).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_cases(spark, tmp_path):
    rows = [(5, "u", "same"), (5, "u", "same"), (3, "v\r\nX: y", "same"), (None, "n", "same"), (None, None, "alone"), (None, None, "alone"), (9, None, None)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as sha1", "'y' as owner", "1 as shard", "2 as bytes")
    archive = warc.write_archive(pages, f"{tmp_path}/a")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archive(archive).collect()), key=str)
    assert got == sorted(
        [(5, 4, "revisit", 3), (5, 4, "revisit", 3), (3, 4, "response", None), (None, 4, "revisit", 3), (None, 5, "response", None),
         (None, 5, "response", None), (9, 0, "response", None)], key=str,
    )
    assert {r["url"] for r in warc.read_archive(archive).collect()} == {"u", "v%0D%0AX: y", "n", None}
    # Equal rows of the smallest id: one is the response.
    twice = warc.write_archive(spark.createDataFrame([(1, "u", "t"), (1, "u", "t"), (2, "w", "t")], PAGES), f"{tmp_path}/b")
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archive(twice).drop("url").collect()) [1:] == [(1, "revisit", 1), (2, "revisit", 1)]


def test_least_payload(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyy"), (4, "d", "yyy")], PAGES)
    archive = warc.write_archive(pages, f"{tmp_path}/a", least=3)
    assert [(r["page_id"], r["record_type"]) for r in warc.read_archive(archive).orderBy("page_id").collect()] == [
        (1, "response"), (2, "response"), (3, "response"), (4, "revisit"),
    ]


def test_empty_table(spark, tmp_path):
    archive = warc.write_archive(spark.createDataFrame([], PAGES), f"{tmp_path}/a")
    assert read(archive) == []


def test_damage_is_noticed(spark, tmp_path):
    archive = warc.write_archive(spark.createDataFrame(corpus(), PAGES), f"{tmp_path}/a")
    path = glob.glob(f"{tmp_path}/a/*.warc.gz")[0]
    content = gzip.decompress(open(path, "rb").read()).replace(b"host1", b"host2", 1)
    with open(path, "wb") as file:
        file.write(gzip.compress(content, mtime=0))
    with pytest.raises(Exception, match="not the file|damaged"):
        read(archive)


@pytest.mark.parametrize("ids", [range(-500, 500), [2**62 + i for i in range(500)] + [-(2**62), 0], [7] * 300])
def test_cut_points_split_the_bytes(spark, ids):
    sizes = spark.createDataFrame([(i, 10) for i in ids], "page_id long, bytes long")
    cuts = warc.cut_points(sizes, 1000)
    assert cuts == sorted(cuts)
    shards = {}
    for i in ids:
        shards[sum(c <= i for c in cuts)] = shards.get(sum(c <= i for c in cuts), 0) + 10
    if len(set(ids)) > 1:
        assert max(shards.values()) <= 1100 and len(shards) >= 4


def test_many_heavy_ranges_take_one_job_per_level(spark, monkeypatch):
    """Clusters of ids far apart: every level of division is one job, however many ranges are heavy."""
    levels = []
    whole = warc._sums
    monkeypatch.setattr(warc, "_sums", lambda *a: levels.append(len(a[1])) or whole(*a))
    monkeypatch.setattr(warc, "BINS", 64)
    ids = [c * 2**50 + i for c in range(-30, 30) for i in range(200)]
    sizes = spark.createDataFrame([(i, 10) for i in ids] + [(None, 10)], "page_id long, bytes long")
    cuts = warc.cut_points(sizes, 500)
    assert max(levels) > 50 and len(levels) <= 16
    shards = np.bincount(np.searchsorted(cuts, ids, "right")) * 10
    assert shards.max() <= 1000 and len(cuts) >= 200


def test_commit_can_be_repeated(spark, tmp_path):
    folder = f"{tmp_path}/a"
    archive = warc.write_archive(spark.createDataFrame(corpus(), PAGES), folder)
    names = [(r["shard"], r["number"], r["name"], r["records"], r["bytes"], r["sha256"], "gone-" + r["name"]) for r in archive.manifest.collect()]
    written = spark.createDataFrame(names, warc.FILE_COLUMNS + ", hidden string")
    os.rename(f"{folder}/manifest", f"{tmp_path}/before")
    again = warc.Archive(folder, warc._commit(spark, written, folder))
    assert read(again) == sorted(wanted(corpus()), key=str)
