from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larder.operators import cachesim, catalog, control, layout, metrics, recovery, routing
from larder.sources.config import Connection, Mapping, Source, Sources, from_environment, project

NOW = datetime(2025, 1, 10)


def ago(**x):
    return NOW - timedelta(**x)


def test_claims_are_per_shard_and_by_id(spark):
    files = spark.createDataFrame([(i, "pending" if i % 4 else "packed", f"k{i}") for i in range(80)], "id long, status string, key string")
    got = control.claim(files, F.col("id") % 2, 3, F.lit("me"), F.lit(NOW))
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 5, 6, 10]
    assert control.applied(files.withColumns({"claimed_by": F.lit(None).cast("string"), "claimed_at": F.lit(None).cast("timestamp")}), got, ["status", "claimed_by", "claimed_at"]).where("status = 'claimed'").count() == 6
    assert control.claim(files, F.col("id") % 2, 3, F.lit("me"), F.lit(NOW), where="key <> 'k1'", shards=[1]).count() == 3


def test_pairs_end_with_the_shorter(spark):
    r = spark.createDataFrame([([1, 2, 3], ["a", "b"])], "i array<long>, n array<string>").select(control.pair_names(F.col("i"), F.col("n")).alias("p")).first()["p"]
    assert [(x["id"], x["des_name"]) for x in r] == [(1, "a"), (2, "b")]


def test_failed_messages_are_cut(spark):
    files = spark.createDataFrame([(1, "claimed", None)], "id long, status string, error_message string")
    r = control.mark_failed(files, spark.createDataFrame([(1, "e" * 900)], "id long, error string")).first()
    assert (r["status"], len(r["error_message"])) == ("failed", 500)


def test_lock_boundaries(spark):
    locks = spark.createDataFrame([(1, "a", ago(seconds=1)), (2, "a", NOW), (3, "a", NOW + timedelta(seconds=5)), (4, "me", NOW + timedelta(seconds=5))], "shard_id int, holder_id string, expires_at timestamp")
    asks = spark.createDataFrame([(i, "me") for i in (1, 2, 3, 4, 5)], "shard_id int, holder_id string")
    got = {r["shard_id"]: (r["acquired"], r["holder_id"]) for r in control.acquire(locks, asks, F.lit(NOW), 30).collect()}
    assert got == {1: (True, "me"), 2: (False, "a"), 3: (False, "a"), 4: (True, "me"), 5: (True, "me")}
    mine = locks.withColumn("holder_id", F.lit("me"))
    got = {r["shard_id"]: (r["renewed"], r["lost"]) for r in control.renew(mine, asks, F.lit(NOW), 30).collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (True, False), 4: (True, False)}
    assert sorted(r["shard_id"] for r in control.release(locks, asks).collect()) == [1, 2, 3]
    assert sorted(r["shard_id"] for r in control.release_expired(locks, F.lit(NOW)).collect()) == [2, 3, 4]
    assert tuple(metrics.lock_health(locks, F.lit(NOW)).first()) == (2, 2)


def test_stale_claims(spark):
    files = spark.createDataFrame([(1, "claimed", "x", ago(seconds=1000)), (2, "claimed", "x", ago(seconds=10)), (3, "claimed", "x", None), (4, "pending", None, None)], "id int, status string, claimed_by string, claimed_at timestamp")
    table, rows = recovery.release_stale(files, F.lit(NOW))
    assert sorted(r["id"] for r in rows.collect()) == [1, 3]
    assert {r["id"]: r["status"] for r in table.collect()} == {1: "pending", 2: "claimed", 3: "pending", 4: "pending"}


def test_partial_integrity_orphans(spark):
    k = spark.createDataFrame([(1, 0, "writing", "a.des", 0, ago(hours=2)), (2, 0, "writing", "b.des", 0, ago(minutes=1)), (3, 0, "uploaded", "c.des", 1, ago(hours=2)), (4, 0, "uploaded", "d.des", 1, ago(hours=2)), (5, 0, "writing", "e.des", 2, ago(hours=2))], "id int, shard_id int, status string, s3_key string, file_count long, created_at timestamp")
    o = spark.createDataFrame([("c.des", True, 1), ("e.des", True, 2), ("x.des", True, 1), ("_bigFiles/y", True, 0)], "key string, valid boolean, file_count long")
    assert {r["id"]: (r["new_status"], r["reason"]) for r in recovery.settle_partial(k, o, F.lit(NOW)).collect()} == {1: ("failed", "missing"), 5: ("uploaded", "complete")}
    assert [(r["id"], r["issue"]) for r in recovery.integrity(k, o).collect()] == [(4, "missing")]
    assert [r["key"] for r in recovery.orphans(o, k).collect()] == ["x.des"]


def test_candidates_and_settling(spark):
    c = spark.createDataFrame([(1, ago(days=2), None, None, None, None), (2, ago(hours=6), None, None, None, None), (3, ago(days=2), None, "h", 1, "failed"), (4, ago(days=2), "n", "h", 1, "marked"), (5, ago(days=3), "n", "h", 1, "retry")], "id int, created_at timestamp, des_name string, des_hash string, des_shard int, des_status string")
    cutoff = F.lit(ago(days=1))
    assert [r["id"] for r in catalog.candidates(c, cutoff, 10).collect()] == [1, 3, 5]
    assert [r["id"] for r in catalog.candidates(c, cutoff, 10, exclude_failed=True).collect()] == [1, 5]
    assert [r["id"] for r in catalog.candidates(c, cutoff, 10, legacy=True).collect()] == [1, 3]
    a = spark.createDataFrame([(1, None, 0), (2, "Connection reset", 0), (3, "Connection reset", 2), (4, "bad", 0)], "id int, error string, retry_count int")
    assert {r["id"]: (r["des_status"], r["wait_seconds"]) for r in catalog.settle(a, 3).collect()} == {1: ("marked", None), 2: ("retry", 1.0), 3: ("failed", None), 4: ("failed", None)}


def test_token_bucket(spark):
    r = spark.range(20).select("id", F.lit(0.0).alias("a"), F.lit(1).alias("k"))
    got = sorted(x["release"] for x in routing.token_bucket(r, ["k"], ["id"], "a", 0.1, 1).collect())
    assert got[0] == 0 and got[-1] == pytest.approx(1.9)


def test_routing(spark):
    ends = spark.createDataFrame([(0, "0", False), (1, "1", True)], "place int, id string, healthy boolean")
    reqs = spark.createDataFrame([(0,), (1,)], "b int")
    got = {r["b"]: (r["target_id"], r["fallback_ids"]) for r in routing.route(reqs, ends, F.col("b")).collect()}
    assert got == {0: ("1", []), 1: ("1", [])}


def test_breaker_opens_and_closes(spark):
    calls = spark.createDataFrame([("e", 0, True), ("e", 1, True), ("e", 2, False), ("e", 3, True), ("e", 4, True), ("e", 50, False)], "k string, t long, bad boolean")
    got = [(r["found_open"], r["failures"]) for r in sorted(routing.breaker_states(calls, "k", ["t"], "t", "bad", 2, 10).collect(), key=lambda r: r["t"])]
    assert got == [(False, 1), (False, 2), (True, 0), (False, 1), (False, 2), (False, 0)]


def test_caches(spark):
    lru = spark.createDataFrame([(i, 0, k) for i, k in enumerate("123142")], "t int, c int, k string")
    assert [r["hit"] for r in sorted(cachesim.lru_hits(lru, "c", ["t"], "k", 3).collect(), key=lambda r: r["t"])] == [False, False, False, True, False, False]
    ttl = spark.createDataFrame([(0, 0, "a"), (9, 0, "a"), (11, 0, "a"), (20, 0, "a")], "t long, c int, k string")
    assert [r["hit"] for r in sorted(cachesim.ttl_hits(ttl, "c", ["t"], "k", "t", 10).collect(), key=lambda r: r["t"])] == [False, True, False, True]


def test_stats_and_ratio(spark):
    m = spark.createDataFrame([(1, 10, 0), (1, 30, 0), (1, 99, 1), (2, 5, 1)], "c int, data_length long, flags long")
    got = {r["c"]: r for r in layout.derived(layout.stats(m, ["c"]).withColumn("archive_size_bytes", F.lit(20).cast("long"))).collect()}
    assert (got[1]["internal_files"], got[1]["total_size_bytes"], got[1]["compression_ratio"]) == (2, 139, 0.5)
    assert got[2]["compression_ratio"] == 0.0


def test_footer_faults(spark):
    good = ("DESFOOT1", 1, 16, 1000, 1016, 200, 1216, 500, 10, 1788)
    bad = [(good, None), (("BADMAGIC", *good[1:]), "invalid footer magic"), ((good[0], 99, *good[2:]), "unsupported version"), ((*good[:2], -1, *good[3:]), "negative field"), ((*good[:3], 5000, *good[4:]), "data overlaps meta")]
    names = ["magic", "version", "data_start", "data_length", "meta_start", "meta_length", "index_start", "index_length", "file_count"]
    df = spark.createDataFrame([b for b, _ in bad], "magic string, version int, " + ", ".join(f"{n} long" for n in names[2:]) + ", size long")
    got = [r[0] for r in df.select(layout.footer_errors({n: F.col(n) for n in names}, F.col("size"))).collect()]
    assert got == [e for _, e in bad]


def test_observed_counters(spark):
    df, seen = metrics.observed(spark.range(5).withColumn("b", F.col("id")), "o", "b")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"files": 5, "bytes": 10}


def test_config():
    c = Connection("mysql", "h", 3306, "d", "u", "secret")
    assert c.url() == "jdbc:mysql://h:3306/d?characterEncoding=utf8mb4" and "secret" not in repr(c)
    assert Connection("oracle", "h", 1521, "s", "u").url() == "jdbc:oracle:thin:@//h:1521/s"
    for bad in ({"type": "sqlite"}, {"port": 0}, {"pool_size": 101}):
        with pytest.raises(ValueError):
            Connection(**({"type": "postgres", "host": "h", "port": 1, "database": "d", "username": "u"} | bad))
    m = Mapping("id", "b", "k", "s")
    with pytest.raises(ValueError):
        Source("a", c, "t", m, shard_bits=17)
    s = Sources((Source("a", c, "t", m, schema="x", shard_bits=4), Source("b", c, "t", m, enabled=False)))
    assert [x.name for x in s.enabled()] == ["a"] and s.by_name("b").shard_bits == 8 and s.by_name("z") is None
    assert s.by_name("a").full_table == "x.t" and s.by_name("a").shard_count == 16
    assert from_environment({"DATABASE_URL": "postgres://u:p@h:5/db"})["database_url"]["port"] == 5


def test_source_projection(spark):
    c = Connection("postgres", "h", 1, "d", "u")
    s = Source("a", c, "t", Mapping("file_id", "bucket", "obj", "size", created_at="at", metadata={"mail": "user"}), shard_key="user", shard_bits=4)
    df = spark.createDataFrame([(1, "b", "k/1", 5, NOW, "u1"), (2, "b", "k/2", 6, None, None)], "file_id long, bucket string, obj string, size int, at timestamp, user string")
    r = {x["id"]: x for x in project(df, s).collect()}
    assert r[1]["metadata"] == {"mail": "u1", "created_at": "2025-01-10T00:00:00Z"} and 0 <= r[2]["shard_id"] < 16


def test_control_tables_can_be_created(spark):
    from larder.schemas import TABLES, create_tables

    create_tables(spark)
    create_tables(spark)
    for name, schema in TABLES.items():
        assert spark.table(name).schema.fieldNames() == schema.fieldNames()
        spark.sql(f"DROP TABLE {name}")


def test_writer_numbers_and_requeue(spark):
    k = spark.createDataFrame([(7, 0, "uploaded")], "id long, shard_id int, status string")
    new = spark.createDataFrame([(1, datetime(2025, 1, 1).date(), "a"), (0, datetime(2025, 1, 1).date(), "b")], "shard_id int, day date, s3_key string")
    assert [(r["id"], r["s3_key"]) for r in control.insert_containers(k, new, F.lit(NOW)).orderBy("id").collect()] == [(8, "b"), (9, "a")]
    c = spark.createDataFrame([(1, "failed", 3), (2, "failed", 3)], "id int, des_status string, retry_count int")
    letters = spark.createDataFrame([(1, False), (2, True)], "catalog_entry_id int, resolved boolean")
    assert {r["id"]: (r["des_status"], r["retry_count"]) for r in catalog.requeue(c, letters).collect()} == {1: ("retry", 0), 2: ("failed", 3)}


def test_database_reads_are_filtered_there():
    c = Connection("postgres", "h", 5432, "d", "u", "p", pool_size=3)
    s = Source("a", c, "t", Mapping("id", "b", "k", "n", status="st", created_at="at"), schema="x", where="kind = 'y' OR z", batch_size=200)
    o = s.options("pen'ding", before="2025-01-01", limit=5, low=1, high=9)
    assert o["dbtable"] == "(SELECT * FROM x.t WHERE (kind = 'y' OR z) AND st = 'pen''ding' AND at <= '2025-01-01' ORDER BY id LIMIT 5) source_rows"
    assert (o["driver"], o["fetchsize"], o["numPartitions"], o["partitionColumn"]) == ("org.postgresql.Driver", "200", "3", "id")
    assert "FETCH NEXT 5 ROWS ONLY" in Source("a", Connection("oracle", "h", 1, "d", "u"), "t", Mapping("id", "b", "k", "n")).query(limit=5)


def test_a_failing_source_leaves_the_others(spark):
    c = Connection("postgres", "h", 5432, "d", "u")
    m = Mapping("id", "bucket", "key", "size")
    own = Sources(tuple(Source(n, c, "t", m) for n in ("bad", "good", "late")))
    rows = spark.createDataFrame([(1, "b", "k", 3)], "id long, bucket string, key string, size long")

    def read(source):
        if source.name == "bad":
            raise ConnectionError("no route")
        return rows if source.name == "good" else rows.withColumn("size", F.raise_error(F.lit("broken row")).cast("long"))

    out, errors = own.read_all(read)
    assert [(r["source_rank"], r["source_name"], r["id"]) for r in out.collect()] == [(1, "good", 1)]
    assert errors["bad"] == "no route" and "broken row" in errors["late"]


def test_only_transient_failures_are_tried_again():
    from larder.sources.retry import call

    waits, tries = [], []

    def action(message, until):
        tries.append(message)
        if len(tries) < until:
            raise OSError(message)
        return "done"

    assert call(lambda: action("Connection timeout", 3), attempts=3, jitter=0, sleep=waits.append) == "done" and waits == [2.0, 4.0]
    for message, attempts, made in (("no such table", 5, 1), ("timeout", 2, 2), ("timeout", 0, 1)):
        tries.clear()
        with pytest.raises(OSError, match=message):
            call(lambda: action(message, 9), attempts=attempts, sleep=waits.append)  # noqa: B023
        assert len(tries) == made


def test_progress_reaches_container_records(spark):
    k = spark.createDataFrame([(1, "writing", 0, 0), (2, "uploaded", 9, 90), (3, "writing", 1, 10)], "id long, status string, file_count long, data_bytes long")
    reached = spark.createDataFrame([(1, 2, 20), (1, 4, 40), (2, 3, 30)], "id long, file_count long, data_bytes long")
    assert {r["id"]: (r["file_count"], r["data_bytes"]) for r in control.progress(k, reached).collect()} == {1: (4, 40), 2: (9, 90), 3: (1, 10)}
