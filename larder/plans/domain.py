"""The test tables as relations of the archive domain, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark, d, payload: bool = False) -> DataFrame:
    """Payload files from documents."""
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.col("source").alias("bucket"), F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("key"), F.octet_length("text").cast("long").alias("size"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(7)).cast("int")).alias("day"), "lang", *(["text"] if payload else []))


FILES = "(SELECT doc_id AS id, source AS bucket, source || '/' || lang || '/' || doc_id || '.txt' AS key, CAST(strlen(text) AS BIGINT) AS size, DATE '2024-01-01' + CAST(doc_id % 7 AS INTEGER) AS day, lang, text FROM documents)"


def source_rows(spark, d) -> DataFrame:
    """A source table from orders: F pending, O claimed, P packed."""
    o, s = table(spark, d, "orders"), F.col("o_orderstatus")
    claimed = s == "O"
    return o.select(F.col("o_orderkey").alias("id"), F.when(s == "F", "pending").when(claimed, "claimed").otherwise("packed").alias("status"), F.col("o_orderdate").alias("created_at"), F.when(claimed & (F.col("o_orderkey") % 10 != 0), F.col("o_orderdate")).alias("claimed_at"), F.when(claimed, F.col("o_orderpriority")).alias("claimed_by"), F.col("o_custkey").alias("shard_key"), F.col("o_totalprice").alias("price"))


SOURCE_ROWS = "(SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'O' THEN 'claimed' ELSE 'packed' END AS status, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 10 <> 0 THEN o_orderdate END AS claimed_at, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS claimed_by, o_custkey AS shard_key, o_totalprice AS price FROM orders)"


def catalog(spark, d) -> DataFrame:
    """A catalog from orders: F unmarked, O to be retried, P marked."""
    o, s = table(spark, d, "orders"), F.col("o_orderstatus")
    key = F.col("o_orderkey")
    done = s == "P"
    text = key.cast("string")
    return o.select(key.alias("id"), F.col("o_orderdate").alias("created_at"), F.when(done & (key % 2 == 0), F.concat(F.lit("n"), text)).alias("des_name"), F.when(done, F.lit("h")).alias("des_hash"), F.when(done, F.lit(1)).alias("des_shard"), F.when(s == "O", "retry").when(done, "marked").alias("des_status"), F.pmod(key, F.lit(4)).cast("int").alias("retry_count"), F.lit(None).cast("string").alias("last_error"), F.concat(F.lit("k/"), text).alias("source_key"))


CATALOG = "(SELECT o_orderkey AS id, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'n' || o_orderkey END AS des_name, CASE WHEN o_orderstatus = 'P' THEN 'h' END AS des_hash, CASE WHEN o_orderstatus = 'P' THEN 1 END AS des_shard, CASE o_orderstatus WHEN 'O' THEN 'retry' WHEN 'P' THEN 'marked' END AS des_status, CAST(o_orderkey % 4 AS INTEGER) AS retry_count, CAST(NULL AS VARCHAR) AS last_error, 'k/' || o_orderkey AS source_key FROM orders)"


def locks(spark, d) -> DataFrame:
    """Last lock by shard (= user) from events, held for a day from its event."""
    e = table(spark, d, "events")
    last = e.groupBy(F.col("user_id").alias("shard_id")).agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("x"))
    return last.select("shard_id", F.col("x.event_type").alias("holder_id"), (F.col("x.ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))


LOCKS = "(SELECT user_id AS shard_id, arg_max(event_type, (ts, event_id)) AS holder_id, max(ts) + INTERVAL 1 DAY AS expires_at FROM events GROUP BY user_id)"


def requests(spark, d) -> DataFrame:
    """Lock requests: of each shard whose first event is no view, by that event's type."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("shard_id")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("holder_id")).where("holder_id <> 'view'")


REQUESTS = "(SELECT * FROM (SELECT user_id AS shard_id, arg_min(event_type, (ts, event_id)) AS holder_id FROM events GROUP BY user_id) WHERE holder_id <> 'view')"


def members(spark, d) -> DataFrame:
    """Container members from line items; a tenth are external."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("container"), "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("data_length"), F.when(F.col("l_discount") >= 0.095, 1).otherwise(0).cast("long").alias("flags"), "l_extendedprice", "l_shipdate")


MEMBERS = "(SELECT l_orderkey AS container, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS data_length, CAST(CASE WHEN l_discount >= 0.095 THEN 1 ELSE 0 END AS BIGINT) AS flags, l_extendedprice, l_shipdate FROM lineitem)"
MEMBER_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def three_sources(spark, d) -> DataFrame:
    """Customers, suppliers and parts as three sources in configuration order."""
    out = None
    for rank, (name, key, label) in enumerate((("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))):
        one = table(spark, d, name).select(F.lit(rank).alias("source_rank"), F.lit(name).alias("source_name"), F.col(key).alias("id"), F.col(label).alias("s3_key"), F.when(F.col(key) % 3 == 0, "packed").otherwise("pending").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


THREE = "(" + " UNION ALL ".join(f"SELECT {r} AS source_rank, '{n}' AS source_name, {k} AS id, {v} AS s3_key, CASE WHEN {k} % 3 = 0 THEN 'packed' ELSE 'pending' END AS status FROM {n}" for r, (n, k, v) in enumerate((("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")))) + ")"


def containers(spark, d) -> DataFrame:
    """Container records from orders."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), F.pmod(k, F.lit(16)).cast("int").alias("shard_id"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "F", "uploaded").when(F.col("o_orderstatus") == "O", "writing").otherwise("failed").alias("status"), F.concat(F.lit("arc/"), k.cast("string"), F.lit(".des")).alias("s3_key"), F.pmod(k, F.lit(5)).alias("file_count"), F.col("o_orderdate").alias("created_at"))


CONTAINERS = "(SELECT o_orderkey AS id, CAST(o_orderkey % 16 AS INTEGER) AS shard_id, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'uploaded' WHEN 'O' THEN 'writing' ELSE 'failed' END AS status, 'arc/' || o_orderkey || '.des' AS s3_key, o_orderkey % 5 AS file_count, o_orderdate AS created_at FROM orders)"


def objects(spark, d) -> DataFrame:
    """Objects in the store: containers that line items belong to; a few are invalid."""
    li = table(spark, d, "lineitem")
    k = F.col("l_orderkey")
    return li.groupBy(F.concat(F.lit("arc/"), k.cast("string"), F.lit(".des")).alias("key"), (k % 11 != 0).alias("valid")).agg(F.count(F.lit(1)).alias("file_count"))


OBJECTS = "(SELECT 'arc/' || l_orderkey || '.des' AS key, l_orderkey % 11 <> 0 AS valid, count(*) AS file_count FROM lineitem GROUP BY ALL)"


def endpoints(spark, n: int = 5) -> DataFrame:
    """A service's endpoints, every third one down."""
    i = F.col("id")
    return spark.range(n).select(i.cast("int").alias("place"), F.concat(F.lit("r"), i.cast("string")).alias("id"), (i % 3 != 1).alias("healthy"))


ENDPOINTS = "(SELECT CAST(range AS INTEGER) AS place, 'r' || range AS id, range % 3 <> 1 AS healthy FROM range(5))"


def sha_bits(x: str, bits: int) -> str:
    return f"(CAST('0x' || substr(sha256({x}), 1, 8) AS BIGINT) >> {32 - bits})"
