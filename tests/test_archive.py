import io
import json
import struct
import time

import pytest
from pyspark.sql import functions as F

from larder.sources import archive, codec, store

MEMBERS = [("a.txt", b"hello", {"mime": "text"}), ("b.bin", b"\0\1\2", {}), ("notes with_space.txt", b"l1\nl2\n", {"meta": {"k": "v"}, "n": [1, 2]}), ("empty", b"", None)]


def save(folder, name="x.des", members=MEMBERS):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(archive.archive_bytes(members))
    return path


def rows(spark, path, **options):
    archive.register(spark)
    return spark.read.format("archive").options(**options).load(str(path))


def test_entry_is_36_bytes_and_empty_archive_88():
    assert codec.ENTRY.size == 36
    assert len(archive.archive_bytes([])) == codec.MIN_SIZE == 88


def test_round_trip(spark, tmp_path):
    save(tmp_path)
    got = {r["name"]: (bytes(r["data"]), json.loads(r["meta"])) for r in rows(spark, tmp_path, payload="true").collect()}
    assert got == {n: (d, {**(m or {}), "size": len(d)}) for n, d, m in MEMBERS}


def test_offsets_lie_in_their_regions(tmp_path):
    raw = save(tmp_path).read_bytes()
    f = codec.parse_footer(raw[-72:], len(raw))
    for e in codec.parse_index(raw[f.index_start :], f.file_count):
        assert f.data_start <= e.data_offset and e.data_offset + e.data_length <= f.meta_start
        assert f.meta_start <= e.meta_offset and e.meta_offset + e.meta_length <= f.index_start


def test_large_metadata(spark, tmp_path):
    meta = {"t": "x" * 10_000, "a": list(range(1000)), "m": {str(i): i for i in range(100)}}
    save(tmp_path, members=[("m", b"d", meta)])
    assert json.loads(rows(spark, tmp_path, meta="true").first()["meta"]) == meta | {"size": 1}


def test_last_of_a_name_wins_and_all_can_be_seen(spark, tmp_path):
    save(tmp_path, members=[("a", b"1", None), ("b", b"2", None), ("a", b"33", None)])
    assert {r["name"]: bytes(r["data"]) for r in rows(spark, tmp_path, payload="true").collect()} == {"a": b"33", "b": b"2"}
    assert rows(spark, tmp_path, duplicates="true").count() == 3
    f = archive.footers(spark, str(tmp_path)).first()
    assert (f["file_count"], f["distinct_count"], f["error"]) == (3, 2, None)


def test_name_filter_goes_into_the_reader(spark, tmp_path):
    save(tmp_path)
    df = rows(spark, tmp_path, payload="true").where(F.col("name").isin("a.txt", "none"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and " Filter " not in plan
    assert [bytes(r["data"]) for r in df.collect()] == [b"hello"]


@pytest.mark.parametrize("first", [True, False])
def test_zero_length_neighbours_do_not_cut_ranges(first):
    spans = [(16, 0), (16, 5), (21, 3)] if first else [(16, 5), (16, 0), (21, 3)]
    assert codec.merged_ranges(spans, 0) == [(16, 24)]


def test_gap_rule_is_inclusive():
    assert codec.merged_ranges([(0, 10), (20, 5)], 10) == [(0, 25)]
    assert codec.merged_ranges([(0, 10), (21, 5)], 10) == [(0, 10), (21, 26)]


PATCHES = [(-72, b"BADMAGIC", "footer magic"), (-64, b"\xff", "version"), (-8, b"\xff" * 8, "file_count"), (-72 + 24, struct.pack("<Q", 999_999_999), "overlaps"), (-72 + 32, struct.pack("<Q", 999_999_999), "exceeds"), (0, b"WRONGMAG", "header magic")]


@pytest.mark.parametrize("at,patch,said", PATCHES)
def test_corruption(spark, tmp_path, at, patch, said):
    path = save(tmp_path, members=MEMBERS[:1])
    raw = bytearray(path.read_bytes())
    at = at % len(raw)
    raw[at : at + len(patch)] = patch
    path.write_bytes(raw)
    assert said in archive.footers(spark, str(tmp_path)).first()["error"]
    with pytest.raises(Exception, match=said):
        rows(spark, tmp_path).collect()
    assert rows(spark, tmp_path, mode="DROPMALFORMED").count() == 0


@pytest.mark.parametrize("cut", [1, 5, 30])
def test_truncated_index(cut):
    raw = archive.archive_bytes(MEMBERS)
    f = codec.parse_footer(raw[-72:], len(raw))
    with pytest.raises(codec.ArchiveError, match="truncated"):
        list(codec.parse_index(raw[f.index_start : f.index_start + f.index_length][: -36 - len("empty") - 2 + cut], f.file_count))


def test_too_small_and_missing(spark, tmp_path):
    (tmp_path / "s.des").write_bytes(b"x" * 87)
    assert archive.footers(spark, str(tmp_path)).first()["error"] == "file too small"
    with pytest.raises(Exception, match="none"):
        rows(spark, tmp_path / "none").collect()


@pytest.mark.parametrize("name", ["", *[f"a{c}b" for c in '/\\:*?"<>|'], "x" * 65536, "\ud800"])
def test_bad_names(name):
    with pytest.raises(codec.ArchiveError):
        codec.Writer(io.BytesIO()).add(name, b"")


def test_external_members(spark, tmp_path):
    df = spark.createDataFrame([("c", "big", bytearray(b"x" * 50), None), ("c", "small", bytearray(b"y"), None), ("c", "forced", bytearray(b"z"), True)], "container string, name string, data binary, force_external boolean")
    archive.register(spark)
    archive.prepare(df).write.format("archive").mode("append").options(externalPrefix="ext", bigFile="50").save(str(tmp_path))
    got = {r["name"]: r for r in rows(spark, tmp_path, payload="true").collect()}
    assert bytes(got["small"]["data"]) == b"y" and got["big"]["data"] is None and got["big"]["flags"] == 1
    key = json.loads(got["forced"]["meta"])["external_key"]
    assert (tmp_path / key).read_bytes() == b"z"
    whole = store.with_external(rows(spark, tmp_path, payload="true"), str(tmp_path))
    assert {r["name"]: bytes(r["data"]) for r in whole.collect()} == {"big": b"x" * 50, "small": b"y", "forced": b"z"}
    (tmp_path / key).unlink()
    assert store.with_external(rows(spark, tmp_path, payload="true"), str(tmp_path)).count() == 2


def test_existing_archive_is_refused_and_nothing_is_left(spark, tmp_path):
    df = spark.createDataFrame([("c", "a", bytearray(b"1"))], "container string, name string, data binary")
    archive.register(spark)
    write = lambda: archive.prepare(df).write.format("archive").mode("append").save(str(tmp_path))
    write()
    with pytest.raises(Exception, match="FileExistsError|c.des"):
        write()
    assert [p.name for p in tmp_path.iterdir()] == ["c.des"]


def test_daily_store_and_lookup(spark, tmp_path):
    df = spark.createDataFrame([(f"N_2025010{1 + i % 2}_{i}.txt", f"2025-01-0{1 + i % 2}", bytearray(b"%d" % i)) for i in range(40)], "name string, day string, data binary").withColumn("day", F.to_date("day"))
    store.write_store(df, str(tmp_path), 3)
    assert {p.parent.name for p in tmp_path.rglob("*.des")} == {"2025-01-01", "2025-01-02"}
    assert store.day_archives(str(tmp_path), "2025-01-01") and all("2025-01-01" in p for p in store.day_archives(str(tmp_path), "2025-01-01"))
    asked = spark.createDataFrame([("N_20250101_0.txt",), ("N_20250101_1.txt",), ("no day",)], "name string")
    got = {r["name"]: (r["status"], r["data"] and bytes(r["data"])) for r in store.lookup(spark, asked, str(tmp_path), 3).collect()}
    assert got == {"N_20250101_0.txt": (200, b"0"), "N_20250101_1.txt": (404, None), "no day": (400, None)}
    sizes = store.lookup(spark, asked, str(tmp_path), 3, payload=False)
    assert "data" not in sizes.columns


def test_lookups_open_only_the_archives_of_their_names(spark, tmp_path):
    df = spark.createDataFrame([(f"N_2025010{1 + i % 2}_{i}.txt", f"2025-01-0{1 + i % 2}", bytearray(b"%d" % i)) for i in range(40)], "name string, day string, data binary").withColumn("day", F.to_date("day"))
    store.write_store(df, str(tmp_path), 3)
    home = archive.home_of("N_20250101_0.txt", 3)
    for p in tmp_path.rglob("*.des"):
        if not str(p).endswith(home):
            p.write_bytes(b"broken" * 100)
    asked = spark.createDataFrame([("N_20250101_0.txt",), ("N_20250101_0.txt",), (None,)], "name string")
    assert sorted((r["status"], r["data"] and bytes(r["data"])) for r in store.lookup(spark, asked, str(tmp_path), 3).collect()) == [(200, b"0"), (200, b"0"), (400, None)]
    one = store.read_store(spark, str(tmp_path), payload=True, bits="3").where("name = 'N_20250101_0.txt'")
    assert [bytes(r["data"]) for r in one.collect()] == [b"0"]
    assert archive.home_of("x_20251399_", 3) is None


def test_newest_batch_is_looked_up(spark, tmp_path):
    for batch, data in (("batch-000000000", b"old"), ("batch-000000001", b"new")):
        df = spark.createDataFrame([("N_20250101_0", bytearray(data))], "name string, data binary").withColumn("day", F.to_date(F.lit("2025-01-01")))
        store.write_store(df, str(tmp_path / batch), 2)
    got = store.lookup(spark, spark.createDataFrame([("N_20250101_0",)], "name string"), str(tmp_path), 2).collect()
    assert [bytes(r["data"]) for r in got] == [b"new"]


def test_directories_are_kept_within_their_limit(tmp_path):
    paths = [save(tmp_path, name, [(f"f{i}", b"x", None) for i in range(6)]) for name in ("a.des", "b.des")]
    kept = archive.Directories(limit=10)
    for p in (paths[0], paths[0], paths[1], paths[0]):
        with archive.file_system(str(p))[0].open_input_file(str(p)) as f:
            assert len(kept.get(f, str(p), p.stat().st_size)[1]) == 6
    assert (kept.hits, kept.misses, kept.entries) == (1, 3, 6)


def test_buffer_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.txt").write_bytes(b"%d" % i)
    store.write_store(store.from_folder(spark, str(tmp_path / "in"), F.to_date(F.lit("2025-11-26"))), str(tmp_path / "out"), 4, hexadecimal=True)
    assert store.read_store(spark, str(tmp_path / "out"), payload=True).count() == 3
    assert store.listing(spark, str(tmp_path / "in")).count() == 3
    keyed = spark.createDataFrame([("f1.txt",), ("gone",)], "s3_key string")
    assert [bytes(r["data"]) for r in store.with_objects(keyed, spark, str(tmp_path / "in")).collect()] == [b"1"]


def test_a_thousand_members_in_two_seconds(tmp_path):
    t = time.time()
    path = save(tmp_path, members=[(f"f{i}", b"x" * 64, {"i": i}) for i in range(1000)])
    assert time.time() - t < 2
    t = time.time()
    reader = archive.ArchiveReader({"path": str(path), "payload": "true"})
    reader.names = {"f500"}
    assert next(reader.read(reader.partitions()[0])).num_rows == 1 and time.time() - t < 2
