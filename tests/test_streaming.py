import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from larder.sources.store import read_store
from larder.streaming import jobs

T = datetime(2025, 1, 1)


def test_marker_job(spark, tmp_path):
    src, marked, dead = (str(tmp_path / x) for x in ("src", "marked", "dead"))
    schema = "id int, created_at timestamp, des_name string, source_key string, retry_count int"
    spark.createDataFrame([(i, T, None, f"k{i}", 0) for i in range(10)], schema).write.parquet(src)
    error = lambda df: F.when(df["id"] == 3, "bad row").when(df["id"] == 4, "timeout")
    for _ in range(2):  # a second run finds nothing new
        jobs.run_marker(spark.readStream.schema(schema).parquet(src), marked, dead, str(tmp_path / "cp"), error=error).awaitTermination()
    got = {r["id"]: r["des_status"] for r in spark.read.parquet(marked).collect()}
    assert got == {i: {3: "failed", 4: "retry"}.get(i, "marked") for i in range(10)}
    assert [r["catalog_entry_id"] for r in spark.read.parquet(dead).collect()] == [3]


def test_packer_job(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(f"N_20250101_{i}", bytearray(b"%d" % i)) for i in range(9)], "name string, data binary").withColumn("day", F.to_date(F.lit("2025-01-01"))).write.parquet(src)
    rows = spark.readStream.schema("name string, data binary, day date").parquet(src)
    jobs.run_packer(rows, str(tmp_path / "store"), 2, str(tmp_path / "cp")).awaitTermination()
    assert read_store(spark, str(tmp_path / "store"), payload=True).count() == 9
    # The same batch once more, as after a failure between its commit and the checkpoint's.
    jobs.run_packer(spark.readStream.schema("name string, data binary, day date").parquet(src), str(tmp_path / "store"), 2, str(tmp_path / "cp2")).awaitTermination()
    assert read_store(spark, str(tmp_path / "store"), payload=True).count() == 9


def test_heartbeat_renews_locks(spark, tmp_path):
    far = datetime(2100, 1, 1)
    locks = spark.createDataFrame([(1, "a", far), (2, "b", T)], "shard_id long, holder_id string, expires_at timestamp_ntz")
    holders = spark.createDataFrame([(1, "a"), (2, "b")], "shard_id long, holder_id string")
    beats = []
    q = jobs.run_heartbeat(spark, lambda: locks, lambda df, n: beats.append({r["shard_id"]: (r["renewed"], r["lost"]) for r in df.collect()}), holders, 30, "1 second", str(tmp_path / "cp"))
    end = time.time() + 60
    while not beats and time.time() < end and q.isActive:
        time.sleep(0.2)
    q.stop()
    assert beats[0] == {1: (True, False), 2: (False, True)}


def test_lock_tracking(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(1, "a", T), (1, "b", T + timedelta(seconds=10)), (1, "b", T + timedelta(seconds=50)), (2, "b", T)]
    spark.createDataFrame(rows, "shard_id long, holder_id string, ts timestamp").write.parquet(src)
    out = jobs.track_locks(spark.readStream.schema("shard_id long, holder_id string, ts timestamp").parquet(src), 30)
    q = out.writeStream.format("memory").queryName("locks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["shard_id"], r["ts"], r["acquired"]) for r in spark.table("locks").collect())
    assert [x[2] for x in got] == [True, False, True, True]
