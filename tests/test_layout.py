"""Order of rows within files, and the size of files."""

import datetime as dt
import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_plans import rows_of

from skyledger.functions.order import interleaved
from skyledger.plans.compaction import compact, packable
from skyledger.schemas import struct
from skyledger.sources.tables import read_table
from skyledger.sources.writers import write_by_date

DAY = dt.date(2024, 1, 1)
FLIGHTS = struct("flight_date DATE, carrier STRING, origin STRING, number BIGINT")


def flights(spark, n, carriers=20, airports=200, seed=0):
    code = lambda column, n: F.concat(*[F.char(65 + (column * step) % 26) for step in (1, 7, 11)][:n])
    carrier, airport = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(carriers)), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(airports))
    return spark.range(seed, seed + n).select(
        F.lit(DAY).alias("flight_date"), code(carrier, 2).alias("carrier"), code(airport, 3).alias("origin"), F.col("id").alias("number")
    )


def groups_read(path, column, value):
    """Row groups of a folder, and those that a filter on one value can not skip."""
    total = hit = 0
    for file in glob.glob(f"{path}/flight_date=*/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        place = meta.schema.names.index(column)
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(place).statistics
            total += 1
            hit += stats.min <= value <= stats.max
    return total, hit


def test_a_filter_on_the_second_column_skips_row_groups(spark, tmp_path):
    rows = flights(spark, 40_000)
    size = {"rows_per_file": 1000, "interleave": True}
    write_by_date(rows, f"{tmp_path}/turns", "flight_date", ["carrier", "origin"], **size)
    # One column after another, as before.
    (rows.coalesce(1).sortWithinPartitions("carrier", "origin").write.option("maxRecordsPerFile", 1000)
     .partitionBy("flight_date").parquet(f"{tmp_path}/lexical"))
    wanted = {c: [r[0] for r in rows.select(c).distinct().orderBy(c).collect()] for c in ("carrier", "origin")}
    share = {}
    for name in ("turns", "lexical"):
        for column, values in wanted.items():
            counts = [groups_read(f"{tmp_path}/{name}", column, v) for v in values]
            share[name, column] = sum(hit for _, hit in counts) / sum(total for total, _ in counts)
    assert share["turns", "origin"] < share["lexical", "origin"] / 2
    assert share["turns", "carrier"] < 0.5


def test_bits_take_turns(spark):
    frame = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), (None, "a"), ("a", None), ("", "é")], "x string, y string")
    got = {(r["x"], r["y"]): r["z"] for r in frame.withColumn("z", interleaved("x", "y")).collect()}

    def plain(x, y):
        bits = ["".join(f"{b:08b}" for b in (t or "").encode()[:3].ljust(3, b"\0")) for t in (x, y)]
        return int("".join(a + b for a, b in zip(*bits)), 2)

    assert got == {key: plain(*key) for key in got}


def test_sort_keys_are_computed_once_per_row(spark, tmp_path, monkeypatch):
    """The write sorts by a finished column; a column of the key is looked at once, not once per bit."""
    rows, sorts = flights(spark, 10), []
    kind, sort = type(rows), type(rows).sortWithinPartitions
    monkeypatch.setattr(kind, "sortWithinPartitions", lambda self, *by, **more: sorts.append(by) or sort(self, *by, **more))
    write_by_date(rows, str(tmp_path), "flight_date", ["carrier", "origin"], interleave=True)
    assert sorts == [("flight_date", "_order")]
    assert read_table(spark, str(tmp_path), FLIGHTS).columns == rows.columns
    plan = rows.select(interleaved("carrier", "origin"))._jdf.queryExecution().analyzed().toString()
    assert plan.split("\n")[0].count("carrier#") == plan.split("\n")[0].count("origin#") == 1


def test_bits_of_many_columns_take_turns(spark):
    for n in (1, 3, 7):
        texts = [chr(200 + k) + "xyz"[k % 3] * 3 for k in range(n)]
        frame = spark.createDataFrame([tuple(texts)], ", ".join(f"c{k} string" for k in range(n)))
        width = min(63 // n, 32) // 8
        bits = ["".join(f"{b:08b}" for b in t.encode()[:width]) for t in texts]
        wanted = int("".join(map("".join, zip(*bits))), 2)
        assert frame.select(interleaved(*frame.columns)).first()[0] == wanted


def test_fifty_appends_end_at_the_target_size(spark, tmp_path):
    path = str(tmp_path)
    for batch in range(50):
        write_by_date(flights(spark, 400, seed=1000 * batch), path, "flight_date", ["carrier", "origin"], mode="append")
    other = flights(spark, 100).withColumn("flight_date", F.date_add("flight_date", 1))
    dateless = flights(spark, 60).withColumn("flight_date", F.lit(None).cast("date"))
    for rows in (other, dateless, dateless):
        write_by_date(rows, path, "flight_date", ["carrier", "origin"], mode="append")
    before = rows_of(read_table(spark, path, FLIGHTS))
    untouched = glob.glob(f"{path}/flight_date=2024-01-02/*.parquet")
    total = sum(map(sum, packable(spark, path, "flight_date").values()))
    target = total // 8
    assert compact(spark, path, FLIGHTS, "flight_date", ["carrier", "origin"], target) == [DAY, None]
    assert rows_of(read_table(spark, path, FLIGHTS)) == before
    files = glob.glob(f"{path}/flight_date=2024-01-01/*.parquet")
    assert 2 <= len(files) <= 9  # files are smaller than before, as they pack better
    assert len(glob.glob(f"{path}/flight_date=__HIVE_DEFAULT_PARTITION__/*.parquet")) == 1
    assert glob.glob(f"{path}/flight_date=2024-01-02/*.parquet") == untouched
    assert compact(spark, f"{path}/none", FLIGHTS, "flight_date") == []
