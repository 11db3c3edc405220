import hashlib

import pytest
from pyspark.sql import functions as F

from larder.functions import predicates as P
from larder.functions import scalars as S


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("bits", [1, 4, 8, 16, 32, 40, 62])
def test_shard_is_the_top_bits(spark, bits):
    words = ["", "a", "zażółć", "file_1.txt", "x" * 500]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], ["w"]).select(S.shard_id(F.col("w"), bits)).collect()]
    assert got == [int(hashlib.sha256(w.encode()).hexdigest(), 16) >> (256 - bits) for w in words]


def test_wide_shards_are_bit_strings(spark):
    got = one(spark, S.shard_id(F.col("w"), 200), w="abc")
    assert got == bin(int(hashlib.sha256(b"abc").hexdigest(), 16))[2:].zfill(256)[:200]


@pytest.mark.parametrize("bits", [0, -1, 257])
def test_bad_bits(bits):
    with pytest.raises(ValueError):
        S.shard_id(F.lit("x"), bits)


def test_distribution(spark):
    assert spark.range(160).select(S.shard_id(F.concat(F.lit("f"), F.col("id").cast("string")), 4).alias("s")).distinct().count() >= 12


def test_names_fit_their_format_and_spill(spark):
    from larder.operators.routing import assign

    rows = spark.range(600).select("id", F.expr("TIMESTAMP '2025-01-01 12:00:00'").alias("ts"))
    names = [r["name"] for r in assign(rows, "TEST", "ts", 1, [], ["id"], 8).collect()]
    assert len(set(names)) == 600 and all(n.startswith("TEST_20250101_(") and n.endswith(")") for n in names)
    f = int(names[0].split("(")[1].split("_")[0], 16)
    assert names[0].endswith(f"_{sum(f.to_bytes(6, 'big')) % 256:02X})")


def test_names_of_crowded_milliseconds_differ(spark):
    from larder.operators.routing import assign

    at = lambda n, expr: spark.range(n).select("id", F.expr(f"TIMESTAMP '2025-01-01 12:00:00' + {expr}").alias("ts"))
    ms = "make_dt_interval(0, 0, 0, CAST({} AS DECIMAL(18, 6)))"
    rows = at(300, ms.format("0")).unionByName(at(10, ms.format("0.001"))).unionByName(at(700, ms.format("65.6"))).unionByName(at(5, ms.format("200"))).withColumn("id", F.monotonically_increasing_id())
    rows = rows.unionByName(spark.createDataFrame([(-1, None)], "id long, ts timestamp"))
    for key in ([], ["k"]):
        got = assign(rows.withColumn("k", F.lit(None).cast("string")), "T", "ts", 1, key, ["id"], 8).orderBy("ts", "id").collect()
        names = [r["name"] for r in got if r["ts"] is not None]
        assert len(got) == 1016 and len(set(names)) == len(names) == 1015 and names == sorted(names)
        place = lambda name: int(name.split("(")[1].split("_")[0], 16)
        first = place(names[0]) >> 16
        assert [(place(n) >> 16) - first for n in (names[255], names[256], names[299], names[300])] == [0, 1, 1, 1]


def test_numbers_along_an_order(spark):
    from larder.operators.ordering import row_numbers
    from larder.operators.routing import round_robin

    rows = spark.range(100).select((F.col("id") * 37 % 100).alias("x"))
    assert all(r["n"] == r["x"] + 1 for r in row_numbers(rows, ["x"], F.expr("x div 10"), "n").collect())
    assert all(r["turn"] == r["x"] % 3 for r in round_robin(rows, ["x"], 3, bucket=F.expr("x div 7")).collect())
    with pytest.raises(ValueError):
        round_robin(rows, ["x"], 3)


@pytest.mark.parametrize("prefix,node,wrap", [("", 0, 32), ("a-b", 0, 32), ("ok", 256, 32), ("ok", 0, 33), ("ok", 0, 0)])
def test_bad_naming(prefix, node, wrap):
    with pytest.raises(ValueError):
        P.valid_naming(prefix, node, wrap)


@pytest.mark.parametrize("name,day", [("A_20250101_(X)", "2025-01-01"), ("A_20251399_(X)", None), ("plain", None), ("a_20240229_b_20250101_", "2024-02-29")])
def test_parse_day(spark, name, day):
    got = one(spark, S.parse_day(F.col("n")), n=name)
    assert (got and str(got)) == day


@pytest.mark.parametrize("name,ok", [("a.txt", True), ("with space", True), ("", False), ("a/b", False), ("a|b", False), ("ż" * 32767, True), ("x" * 65535, True), ("x" * 65536, False)])
def test_names(spark, name, ok):
    assert one(spark, P.valid_name(F.col("n")), n=name) is ok


@pytest.mark.parametrize("parameter,byte", [("300", 300), ("-3", -3), ("0x1A", 26), ("0b11", 3), ("0o17", 15), ("zz", None)])
def test_explicit_byte(spark, parameter, byte):
    assert one(spark, S.hash_byte(F.col("n"), None, F.col("p")), n="x", p=parameter) == byte


def test_given_hash_and_bad_hash(spark):
    assert one(spark, S.hash_byte(F.col("n"), F.col("h")), n="x", h="aBcd") == 0xAB
    assert one(spark, S.hash_byte(F.col("n"), F.col("h")), n="x", h="q") is None
    assert one(spark, S.hash_byte(F.col("n")), n="x") == hashlib.sha256(b"x").digest()[0]


def test_keys(spark):
    assert one(spark, S.container_key("arc", F.to_date(F.lit("2025-01-02")), F.lit(123))) == "arc/2025-01-02/shard_123.des"
    assert one(spark, S.container_key("arc", F.to_date(F.lit("2025-01-02")), F.lit(3))) == "arc/2025-01-02/shard_03.des"
    assert one(spark, S.full_key(F.lit("base/x"), "base")) == "base/x"
    assert one(spark, S.upload_key(F.lit("/shard_00.des"), "base")) == "base/shard_00.des"
    assert one(spark, S.shard_hex(F.lit(10), 10)) == "00a"
    assert one(spark, S.parent_prefix(F.lit("a/b/c"))) == "a/b" and one(spark, S.parent_prefix(F.lit("c"))) == ""


@pytest.mark.parametrize("size,text", [(0, "0.0B"), (1023, "1023.0B"), (1024, "1.0KB"), (30976, "30.2KB"), (500_000_000, "476.8MB"), (5 * 1024**5, "5.0PB")])
def test_human_size(spark, size, text):
    assert one(spark, S.human_size(F.col("s")), s=size) == text


def test_retry_waits(spark):
    assert [one(spark, S.retry_wait(F.lit(a))) for a in (1, 2)] == [2.0, 4.0]
    assert one(spark, S.retry_wait(F.lit(1), base=0.0)) == 0.0 and one(spark, S.retry_wait(F.lit(1), base=-2.0)) == -2.0
    assert one(spark, S.retry_wait(F.lit(2), jitter=F.lit(1.5))) == 6.0
    assert [one(spark, S.router_wait(F.lit(a))) for a in (1, 2, 3, 4)] == [1.0, 2.0, 3.0, 3.0]
    assert one(spark, S.attempts_made(F.lit(0))) == 1


@pytest.mark.parametrize("flags,text", [(0, ""), (1, "EXTERNAL"), (6, "COMPRESSED,ENCRYPTED"), (8, "")])
def test_flags(spark, flags, text):
    assert one(spark, S.flag_labels(F.col("f")), f=flags) == text
    assert one(spark, P.is_external(F.col("f")), f=flags) is bool(flags & 1)
