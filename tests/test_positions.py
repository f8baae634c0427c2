import datetime as dt
import json
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skyledger.functions.times import utc_iso
from skyledger.operators.positions import fact_positions, silver_positions, within
from skyledger.plans.ingest import land_positions, land_state_vectors
from skyledger.schemas import FACT_POSITIONS, RAW_POSITION, STATE_VECTOR
from skyledger.sources.payloads import (
    explode_positions,
    explode_state_vectors,
    position_records,
    read_responses,
    rejected_payloads,
    stamped_lines,
)
from skyledger.sources.tables import read_positions, read_table
from skyledger.streaming.positions import drop_recent_copies, load_positions, stream_positions

POLLED = dt.datetime(2026, 3, 10, 6, 0, 5, 123456)
SAMPLE = {
    "meta": {"count": 1, "source": "test"},
    "data": [
        {
            "icao24": "4CA7F2", "fr24_id": "3f0c77aa", "callsign": "EIN52K", "on_ground": False,
            "lon": -6.27, "lat": 53.42, "vspeed": -640, "gspeed": 212, "alt": 4125,
        }
    ],
}


@pytest.fixture
def responses(spark):
    def build(*payloads, at=POLLED):
        texts = [(p if isinstance(p, str) else json.dumps(p), at) for p in payloads]
        return spark.createDataFrame(texts, "payload string, polled_at timestamp")

    return build


def test_records_are_stamped_and_otherwise_unchanged(responses):
    deep = {"x": {"deep": [1, None]}, "note": 'quote " and é', "lat": None}
    odd = {"data": [deep, {}, {"ingestion_timestamp": "old"}]}
    lines = [json.loads(r["value"]) for r in stamped_lines(position_records(responses(SAMPLE, odd))).collect()]
    stamp = {"ingestion_timestamp": "2026-03-10T06:00:05.123456+00:00"}
    assert lines == [SAMPLE["data"][0] | stamp, deep | stamp, stamp, stamp]


@pytest.mark.parametrize("payload", [{"data": [], "meta": {"count": 0}}, {"meta": {}}, {"data": None}])
def test_empty_responses_write_nothing(responses, payload, tmp_path):
    done = land_positions(responses(payload), str(tmp_path / "bronze"))
    assert (done.path, done.rows) == (None, 0)
    assert done.measures["rejected"] == 0
    assert not (tmp_path / "bronze").exists()


def test_what_is_no_response_is_kept_and_counted(responses, spark, tmp_path):
    mixed = {"data": [{"fr24_id": "a"}, "abc", [1, 2], None]}
    payloads = ["no json", "<html>", '{"data":[{"fr24_id":"x"}', {"data": 5}, {"data": {"a": 1}}, "", mixed]
    done = land_positions(responses(*payloads), str(tmp_path))
    assert (done.rows, done.measures["rejected"]) == (1, 9)
    refused = spark.read.parquet(f"{tmp_path}/rejected/fr24")
    assert sorted(r["reason"] for r in refused.collect()) == ["no object"] * 3 + ["no response"] * 6
    assert {r["payload"] for r in refused.collect()} >= {"no json", "<html>", "abc", "[1,2]", None}
    states = land_state_vectors(responses({"states": [["x1"], {"a": 1}]}, "oops"), str(tmp_path))
    assert (states.rows, states.measures["rejected"]) == (1, 2)


def test_a_stamp_comes_once(responses):
    """A record that has the field already gets the new value in its place."""
    had = {"data": [{"ingestion_timestamp": "old", "v": 1.25, "s": 'x"ingestion_timestamp"', "n": None, "deep": {"ingestion_timestamp": 1}}]}
    (line,) = [r["value"] for r in stamped_lines(position_records(responses(had))).collect()]
    pairs = json.loads(line, object_pairs_hook=list)
    assert [k for k, _ in pairs].count("ingestion_timestamp") == 1
    record = json.loads(line)
    assert record == {**had["data"][0], "ingestion_timestamp": "2026-03-10T06:00:05.123456+00:00"}


def test_landing_folders_and_read_back(responses, spark, tmp_path):
    done = land_positions(responses(SAMPLE), str(tmp_path))
    assert done.rows == 1
    assert list((tmp_path / "fr24" / "year=2026" / "month=03" / "day=10").glob("*.txt"))
    (row,) = read_positions(spark, done.path).collect()
    assert (row["callsign"], row["alt"], row["hex"], row["broken_line"]) == ("EIN52K", 4125, None, None)
    assert row["ingestion_timestamp"] == "2026-03-10T06:00:05.123456+00:00"


def test_typed_explode(responses):
    (row,) = explode_positions(responses(SAMPLE, {"data": []})).collect()
    assert (row["icao24"], row["gspeed"], row["on_ground"]) == ("4CA7F2", 212, False)


def test_an_element_that_is_no_object_spoils_no_other(responses):
    a, b = {"fr24_id": "a", "lat": 53.42, "alt": 4125}, {"fr24_id": "b", "gspeed": 212}
    mixed = [{"data": ["text", a, b]}, {"data": [a, [1], b]}, {"data": [None, a, 5, b]}, {"data": [a, b]}]
    got = [(r["fr24_id"], r["lat"], r["alt"], r["gspeed"]) for r in explode_positions(responses(*mixed)).collect()]
    assert sorted(got, key=str) == [("a", 53.42, 4125, None)] * 4 + [("b", None, None, 212)] * 4
    assert rejected_payloads(responses(*mixed)).count() == 4


def test_responses_are_parsed_once_and_leave_nothing_where_nothing_is(spark, responses, tmp_path):
    mixed = responses({"data": ["text", {"fr24_id": "a"}]})
    for rows in (rejected_payloads(mixed), position_records(mixed)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1
    done = land_positions(responses({"data": []}), str(tmp_path / "empty"))
    assert (done.path, done.rows, done.measures["rejected"]) == (None, 0, 0)
    assert not (tmp_path / "empty" / "fr24").exists() and not (tmp_path / "empty" / "rejected").exists()
    first = land_positions(mixed, str(tmp_path))
    files = sorted(f for f in tmp_path.rglob("part-*"))
    again = land_positions(responses({"data": []}), str(tmp_path))
    assert (first.rows, first.measures["rejected"], again.path, again.rows) == (1, 1, None, 0)
    assert sorted(f for f in tmp_path.rglob("part-*")) == files


def test_state_vectors_by_position(responses):
    head = ["4b1", "SWR1  ", "Switzerland", 1, 2, 8.5, 47.4, 1000, True, 12.5, 90, None]
    full = head + [[7, 8], 1010.5, "1000", False, 0, 3]
    states = {"states": [full, ["x1"], full + ["surplus"]]}
    got = explode_state_vectors(responses(states, {"states": None}, {"time": 1}))
    assert got.dtypes == [(f.name, f.dataType.simpleString()) for f in STATE_VECTOR]
    rows = [tuple(r) for r in got.collect()]
    typed = (*head, "[7,8]", 1010.5, "1000", False, 0, 3)
    assert rows == [typed, ("x1",) + (None,) * 17, typed]


def test_state_vectors_land_with_nulls(responses, spark, tmp_path):
    done = land_state_vectors(responses({"states": [["x1", None]]}), str(tmp_path))
    (line,) = spark.read.text(done.path).select("value").collect()
    record = json.loads(line["value"])
    assert list(record) == STATE_VECTOR.names and record["icao24"] == "x1" and record["callsign"] is None
    assert land_state_vectors(responses({"states": []}), str(tmp_path)).path is None


def test_saved_responses(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(SAMPLE, indent=2))
    (tmp_path / "b.json").write_text('{"meta":{}}')
    assert read_responses(spark, str(tmp_path)).count() == 2
    assert explode_positions(read_responses(spark, str(tmp_path))).count() == 1


def test_units_and_keys(responses):
    facts = fact_positions(silver_positions(explode_positions(responses(SAMPLE))))
    assert facts.dtypes == [(f.name, f.dataType.simpleString()) for f in FACT_POSITIONS]
    (row,) = facts.collect()
    assert (row["altitude_metres"], row["velocity_ms"]) == (4125 * 0.3048, 212 * 0.514444)
    assert (row["icao24"], row["date_sk"], row["position_date"]) == ("4CA7F2", "20260310", dt.date(2026, 3, 10))


def test_bounding_box(spark):
    points = [(49.0, -8.5), (61.5, 10.5), (48.99, 0.0), (61.51, 0.0), (55.0, -8.51), (55.0, 10.51), (None, 0.0)]
    rows = spark.createDataFrame(points, "lat double, lon double")
    assert [tuple(r) for r in within(rows).collect()] == points[:2]


def numbered(n, at=POLLED):
    return {"data": [SAMPLE["data"][0] | {"fr24_id": f"id{i}"} for i in range(n)]}


def test_batch_load_stores_each_position_once(responses, spark, tmp_path):
    facts = str(tmp_path / "facts")
    raw = explode_positions(responses(numbered(3), numbered(2)))  # two copies of id0 and id1
    assert load_positions(raw, facts).rows == 3
    assert load_positions(raw, facts).rows == 0
    later = explode_positions(responses(numbered(2), at=POLLED + dt.timedelta(days=40)))
    assert load_positions(later.unionByName(raw), facts).rows == 2
    assert read_table(spark, facts, FACT_POSITIONS).count() == 5


def test_positions_without_time_are_kept_once(spark, tmp_path):
    rows = spark.createDataFrame([tuple("n1" if n == "fr24_id" else None for n in RAW_POSITION.names)], RAW_POSITION)
    assert load_positions(rows, str(tmp_path / "facts")).rows == 1
    assert load_positions(rows, str(tmp_path / "facts")).rows == 0
    assert load_positions(rows.limit(0), str(tmp_path / "facts")).path is None


def test_positions_without_flight_id_stay_apart(responses, spark, tmp_path):
    nameless = {"data": [{"callsign": "A"}, {"callsign": "B"}, {"callsign": "B"}, {"hex": "B"}]}
    assert load_positions(explode_positions(responses(nameless)), str(tmp_path / "facts")).rows == 3
    assert load_positions(explode_positions(responses(nameless)), str(tmp_path / "facts")).rows == 0


def test_stream_takes_new_files_only(responses, spark, tmp_path):
    work = {n: str(tmp_path / n) for n in ("bronze", "facts", "checkpoint")}

    def run(*payloads, at=POLLED):
        land_positions(responses(*payloads, at=at), work["bronze"])
        query = stream_positions(spark, f"{work['bronze']}/fr24", work["facts"], work["checkpoint"])
        query.awaitTermination()
        seen = sum(p["numInputRows"] for p in query.recentProgress)
        return seen, read_table(spark, work["facts"], FACT_POSITIONS).count()

    assert run(numbered(3))[1] == 3
    seen, stored = run(numbered(4))  # a replay of three and one new
    assert stored == 4
    # A replay from before everything seen is still recognised, and a late new record is kept.
    assert run(numbered(1), at=POLLED - dt.timedelta(days=90))[1] == 5
    assert run(numbered(1), at=POLLED - dt.timedelta(days=90))[1] == 5


def test_late_files_are_loaded(responses, spark, tmp_path):
    """Files that land after a run but are much older than those before it."""
    work = {n: str(tmp_path / n) for n in ("bronze", "facts", "checkpoint", "archive")}
    stored = []
    for number, days in enumerate((0, 10, 400)):
        landed = land_positions(responses({"data": [{"fr24_id": f"f{number}"}]}), work["bronze"])
        for path in Path(landed.path).rglob("*.txt"):
            if number == 0 or path.stat().st_mtime > before:
                os.utime(path, (time.time() - days * 86_400,) * 2)
        stream_positions(spark, landed.path, work["facts"], work["checkpoint"], archive=work["archive"]).awaitTermination()
        before = time.time() - 0.5 if number == 0 else before
        stored.append(read_table(spark, work["facts"], FACT_POSITIONS).count())
    assert stored == [1, 2, 3]


def test_broken_lines_stay_in_staging(responses, spark, tmp_path):
    landed = land_positions(responses(numbered(2)), str(tmp_path / "bronze"))
    (tmp_path / "bronze" / "fr24" / "broken.txt").write_text('{"fr24_id": "cut\n\x00\n[1]\n{"fr24_id": "late"}\n')
    done = []
    stream_positions(spark, landed.path, str(tmp_path / "facts"), str(tmp_path / "checkpoint"), on_batch=done.append).awaitTermination()
    assert (sum(d.rows for d in done), sum(d.measures["rejected"] for d in done)) == (3, 3)
    staged = spark.read.parquet(f"{tmp_path}/facts_staging")
    assert {r["broken_line"] for r in staged.collect()} == {None, '{"fr24_id": "cut', "\x00", "[1]"}
    assert read_table(spark, str(tmp_path / "facts"), FACT_POSITIONS).count() == 3


def test_streaming_copies_within_watermark(responses, spark, tmp_path):
    landed = land_positions(responses(numbered(3), numbered(3)), str(tmp_path / "bronze"))
    arriving = spark.readStream.schema(RAW_POSITION).option("recursiveFileLookup", True).json(landed.path)
    query = (
        drop_recent_copies(arriving)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert read_table(spark, str(tmp_path / "out"), FACT_POSITIONS).select(F.count("*")).first()[0] == 3


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_keys_and_dates_do_not_depend_on_the_session_zone(spark, zone):
    """Also within the hours that a clock change skips or repeats."""
    moments = ["2024-03-10T02:30:00.000001", "2024-03-10T07:00:00", "2024-11-03T01:30:00.5", "2024-11-03T06:30:00.5",
               "2024-11-03T23:59:59.999999", "1969-12-31T23:59:59.25", None]
    raw = [{"fr24_id": "a", "ingestion_timestamp": m and m + "+00:00"} for m in moments]
    rows = spark.createDataFrame([tuple(r.get(n) for n in RAW_POSITION.names) for r in raw], RAW_POSITION)

    def result():
        facts = fact_positions(silver_positions(rows))
        return facts.select("position_sk", "date_sk", "position_date", utc_iso(F.col("ingestion_timestamp"))).collect()

    expected = result()
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert result() == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    texts = [r[3] for r in expected]
    assert texts == [m and dt.datetime.fromisoformat(m + "+00:00").isoformat(timespec="microseconds") for m in moments]
    assert len({r["position_sk"] for r in expected}) == 7
