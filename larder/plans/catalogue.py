"""The query catalogue: each operator of the archive domain over the test tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import cachesim, catalog, control, layout, metrics, recovery, routing
from ..sources import archive, store
from . import domain as D
from .registry import query

c, lit = F.col, F.lit
NOW = "1998-09-01 00:00:00"
EVENTS_NOW = "2024-01-20 00:00:00"
#: A time at which some of the last locks have expired.
LOCKS_NOW = "2024-01-31 12:00:00"


def ntz(text: str):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


# --- names and shards -------------------------------------------------------------------------------


@query("q_shard_assign", f"SELECT id, key, {D.sha_bits('key', 8)} AS shard_id, {D.sha_bits('key', 32)} AS shard32 FROM {D.FILES}")
def q_shard_assign(spark, d):
    return D.files(spark, d).select("id", "key", S.shard_id(c("key"), 8).alias("shard_id"), S.shard_id(c("key"), 32).alias("shard32"))


@query("q_shard_histogram", f"SELECT {D.sha_bits('key', 4)} AS shard_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM {D.FILES} GROUP BY ALL")
def q_shard_histogram(spark, d):
    return D.files(spark, d).groupBy(S.shard_id(c("key"), 4).alias("shard_id")).agg(F.count(lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("q_shard_count_distinct", f"SELECT count(DISTINCT {D.sha_bits('key', 8)}) AS shards, count(*) AS n FROM {D.FILES}")
def q_shard_count_distinct(spark, d):
    return D.files(spark, d).agg(F.count_distinct(S.shard_id(c("key"), 8)).alias("shards"), F.count(lit(1)).alias("n"))


_F48 = "((slot // 256) & 4294967295) * 65536 + 7 * 256 + slot % 256"


def _sql_named(events: str) -> str:
    """Events with the 48-bit value of their name: rows in order, each at the first place free at or after 256 times its millisecond."""
    return f"(SELECT *, upper(lpad(to_hex(f), 12, '0')) AS h FROM (SELECT event_id, ts, {_F48} AS f FROM (SELECT *, n + max(256 * (epoch_us(ts) // 1000) - n) OVER (ORDER BY n) AS slot FROM (SELECT *, row_number() OVER (ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM {events}))))"


_NAMED = _sql_named("events")
_CHECK = "((f & 255) + ((f >> 8) & 255) + ((f >> 16) & 255) + ((f >> 24) & 255) + ((f >> 32) & 255) + ((f >> 40) & 255)) % 256"
_NAME = f"('EV_' || strftime(ts, '%Y%m%d') || '_(' || h || '_' || upper(lpad(to_hex({_CHECK}), 2, '0')) || ')')"


def _named(spark, d):
    return routing.assign(D.table(spark, d, "events").select("event_id", "ts"), "EV", "ts", 7, [], ["event_id"], 8)


@query("q_snowflake_names", f"SELECT event_id, {_NAME} AS name FROM {_NAMED}")
def q_snowflake_names(spark, d):
    return _named(spark, d).select("event_id", "name")


_BURST = "(SELECT event_id, date_trunc('day', ts) + INTERVAL 1 MILLISECOND * (event_id % 3) AS ts FROM events)"


@query("q_snowflake_burst", f"SELECT event_id, {_NAME} AS name FROM {_sql_named(_BURST)}")
def q_snowflake_burst(spark, d):
    """A day's events within three milliseconds: names spill into those that follow, and no two are alike."""
    e = D.table(spark, d, "events")
    rows = e.select("event_id", (F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, CAST(event_id % 3 AS DECIMAL(18, 6)) / 1000)")).alias("ts"))
    return routing.assign(rows, "EV", "ts", 7, [], ["event_id"], 8).select("event_id", "name")


@query("q_name_checksum", f"SELECT event_id, CAST({_CHECK} AS BIGINT) AS checksum FROM {_NAMED}")
def q_name_checksum(spark, d):
    f = F.conv(F.regexp_extract("name", "_\\(([0-9A-F]{12})_", 1), 16, 10).cast("long")
    return _named(spark, d).select("event_id", S.checksum_byte(f).cast("long").alias("checksum"))


@query("q_name_parse_day", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def q_name_parse_day(spark, d):
    return _named(spark, d).select("event_id", S.parse_day(c("name")).alias("day"))


@query("q_assign", f"SELECT event_id, name, {D.sha_bits('name', 8)} AS shard_id, day FROM (SELECT event_id, {_NAME} AS name, CAST(ts AS DATE) AS day FROM {_NAMED})")
def q_assign(spark, d):
    return _named(spark, d).select("event_id", "name", "shard_id", "day")


@query("q_locate", f"SELECT event_id, day, shard_id, 'arc/' || strftime(day, '%Y-%m-%d') || '/shard_' || printf('%02d', shard_id) || '.des' AS container_key, 200 AS status FROM (SELECT event_id, CAST(ts AS DATE) AS day, {D.sha_bits(_NAME, 8)} AS shard_id FROM {_NAMED})")
def q_locate(spark, d):
    return routing.locate(_named(spark, d).select("event_id", "name"), "arc", 8).select("event_id", "day", "shard_id", "container_key", "status")


@query("q_shard_table", f"SELECT CAST(range AS BIGINT) AS shard_id, CAST(range % 3 AS INTEGER) AS worker, 256 AS shards, {D.sha_bits('CAST(range AS VARCHAR)', 8)} AS hashed FROM range(256)")
def q_shard_table(spark, d):
    return spark.range(256).select(c("id").alias("shard_id"), S.worker_of(c("id"), 3).cast("int").alias("worker"), S.shard_count(8).alias("shards"), S.shard_id(c("id").cast("string"), 8).alias("hashed"))


@query("q_pod_shards", "SELECT CAST(range % 3 AS INTEGER) AS pod, count(*) AS shards, CAST(sum(range) AS BIGINT) AS total FROM range(64) GROUP BY ALL")
def q_pod_shards(spark, d):
    return spark.range(64).groupBy(S.worker_of(c("id"), 3).cast("int").alias("pod")).agg(F.count(lit(1)).alias("shards"), F.sum("id").alias("total"))


# CRC-32 of the key in SQL: a list with each byte and seven marks, folded bit by bit.
_CRC_BITS = "list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, strlen(key) + 1), lambda i: [ord(substr(key, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1])))"
_CRC_STEP = "CASE WHEN x >= 0 THEN xor(c, x) ELSE c END"
_CRC = f"(xor(list_reduce({_CRC_BITS}, lambda c, x: xor(({_CRC_STEP}) >> 1, 3988292384 * (({_CRC_STEP}) & 1))), 4294967295) & 255)"


@query("q_crc_layout", f"SELECT id, {_CRC} AS shard_id, upper(to_hex({_CRC})) AS label FROM {D.FILES}")
def q_crc_layout(spark, d):
    return D.files(spark, d).select("id", S.crc_layout(c("key"), 8).alias("shard_id"), F.upper(F.hex(S.crc_layout(c("key"), 8))).alias("label"))


@query("q_name_ext", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '.' || lang ELSE '.txt' END AS ext FROM documents")
def q_name_ext(spark, d):
    k = c("doc_id") % 3
    return D.table(spark, d, "documents").select("doc_id", S.dotted_extension(F.when(k == 1, F.concat(lit("."), c("lang"))).when(k == 2, "txt")).alias("ext"))


@query("q_validate_names", "SELECT p_partkey, regexp_matches(replace(p_name, ' ', '_'), '^[A-Za-z_][A-Za-z0-9_]*$') AS plain, regexp_matches(p_name || '.x', '^[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)*$') AS dotted, regexp_matches(p_type, '^[A-Za-z0-9]+$') AS prefix_ok FROM part")
def q_validate_names(spark, d):
    return D.table(spark, d, "part").select("p_partkey", P.safe_identifier(F.replace("p_name", lit(" "), lit("_"))).alias("plain"), P.safe_identifier(F.concat("p_name", lit(".x")), True).alias("dotted"), P.valid_prefix(c("p_type")).alias("prefix_ok"))


@query("q_ordinal", "SELECT p_partkey, TRY_CAST(nullif(regexp_extract(host, '-([0-9]+)$', 1), '') AS INTEGER) AS ordinal FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'host' ELSE 'pack-' || p_partkey END AS host FROM part)")
def q_ordinal(spark, d):
    host = F.when(c("p_partkey") % 4 == 0, "host").otherwise(F.concat(lit("pack-"), c("p_partkey").cast("string")))
    return D.table(spark, d, "part").select("p_partkey", S.ordinal(host).alias("ordinal"))


# --- catalog ------------------------------------------------------------------------------------------


@query("q_mark_candidates_legacy", f"SELECT id FROM {D.CATALOG} WHERE created_at <= TIMESTAMP '{NOW}' AND (des_status IS NULL OR des_status <> 'DES_TODO') AND (des_name IS NULL OR des_hash IS NULL OR des_shard IS NULL) ORDER BY id LIMIT 500")
def q_mark_candidates_legacy(spark, d):
    return catalog.candidates(D.catalog(spark, d), ntz(NOW), 500, legacy=True).select("id")


_CAND = f"SELECT * FROM {D.CATALOG} WHERE created_at <= TIMESTAMP '{NOW}' AND (des_status IS NULL OR des_status = 'retry' OR des_name IS NULL) ORDER BY id LIMIT 500"


@query("q_mark_candidates_advanced", f"SELECT id, des_status FROM ({_CAND})")
def q_mark_candidates_advanced(spark, d):
    return catalog.candidates(D.catalog(spark, d), ntz(NOW), 500).select("id", "des_status")


@query("q_mark_batch", f"SELECT id, source_key AS des_name, sha256(source_key) AS des_hash, CAST(CAST('0x' || substr(sha256(source_key), 1, 2) AS BIGINT) AS INTEGER) AS des_shard, 'marked' AS des_status FROM ({_CAND})")
def q_mark_batch(spark, d):
    return catalog.mark(catalog.candidates(D.catalog(spark, d), ntz(NOW), 500), c("source_key")).select("id", "des_name", "des_hash", "des_shard", "des_status")


@query("q_mark_legacy", f"SELECT id, coalesce(des_name, source_key) AS des_name, coalesce(des_hash, sha256(source_key)) AS des_hash, coalesce(des_shard, CAST({D.sha_bits('source_key', 4)} AS INTEGER)) AS des_shard, 'DES_TODO' AS des_status FROM {D.CATALOG}")
def q_mark_legacy(spark, d):
    return catalog.mark(D.catalog(spark, d), c("source_key"), legacy_bits=4).select("id", "des_name", "des_hash", "des_shard", "des_status")


_ERR = "CASE event_type WHEN 'error' THEN 'Connection timeout' WHEN 'view' THEN 'bad value' END"
_ATT = f"(SELECT event_id AS id, {_ERR} AS error, CAST(event_id % 4 AS INTEGER) AS retry_count FROM events)"


def _attempts(spark, d):
    e = D.table(spark, d, "events")
    return e.select(c("event_id").alias("id"), F.when(c("event_type") == "error", "Connection timeout").when(c("event_type") == "view", "bad value").alias("error"), F.pmod("event_id", lit(4)).cast("int").alias("retry_count"))


_AGAIN = "(error IS NOT NULL AND regexp_matches(lower(error), 'timeout|connection|deadlock|lock|temporary') AND retry_count + 1 < 3)"


@query("q_settle_attempts", f"SELECT id, CASE WHEN error IS NULL THEN 'marked' WHEN {_AGAIN} THEN 'retry' ELSE 'failed' END AS des_status, CASE WHEN error IS NULL THEN retry_count ELSE retry_count + 1 END AS retry_count, substr(error, 1, 500) AS last_error, CASE WHEN {_AGAIN} THEN pow(2.0, retry_count) END AS wait_seconds FROM {_ATT}")
def q_settle_attempts(spark, d):
    return catalog.settle(_attempts(spark, d), 3).select("id", "des_status", "retry_count", "last_error", "wait_seconds")


_LETTERS = f"(SELECT id AS catalog_entry_id, substr(error, 1, 500) AS error_message, 3 AS retry_count, false AS resolved FROM {_ATT} WHERE error IS NOT NULL AND NOT {_AGAIN})"


def _letters(spark, d):
    failed = _attempts(spark, d)
    settled = catalog.settle(failed, 3).where("des_status = 'failed'").select("id", c("error"))
    return catalog.dead_letters(settled, 3, ntz(EVENTS_NOW))


@query("q_dlq_rows", f"SELECT * FROM {_LETTERS}")
def q_dlq_rows(spark, d):
    return _letters(spark, d).select("catalog_entry_id", "error_message", "retry_count", "resolved")


@query("q_dlq_requeue", f"SELECT id, CASE WHEN hit THEN 'retry' ELSE des_status END AS des_status, CASE WHEN hit THEN 0 ELSE retry_count END AS retry_count FROM (SELECT *, id IN (SELECT catalog_entry_id FROM {_LETTERS} WHERE NOT resolved) AS hit FROM {D.CATALOG})")
def q_dlq_requeue(spark, d):
    return catalog.requeue(D.catalog(spark, d), _letters(spark, d)).select("id", "des_status", "retry_count")


@query("q_error_breakdown", f"SELECT error_message, count(*) AS n FROM {_LETTERS} GROUP BY ALL")
def q_error_breakdown(spark, d):
    return metrics.errors_by_message(_letters(spark, d))


# --- claims and marks ---------------------------------------------------------------------------------

_SHARD4 = D.sha_bits("CAST(shard_key AS VARCHAR)", 4)
_CLAIM = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY id) AS n FROM (SELECT *, {_SHARD4} AS shard_id FROM {D.SOURCE_ROWS} WHERE status = 'pending')) WHERE n <= 5)"


def _claimed(spark, d):
    return control.claim(D.source_rows(spark, d), S.source_shard(c("shard_key"), c("id"), 4), 5, lit("me"), ntz(NOW))


@query("q_claim_topk_per_shard", f"SELECT id, shard_id, 'claimed' AS status, 'me' AS claimed_by FROM {_CLAIM}")
def q_claim_topk_per_shard(spark, d):
    return _claimed(spark, d).select("id", "shard_id", "status", "claimed_by")


@query("q_claim_applied", f"SELECT s.id, CASE WHEN k.id IS NULL THEN s.status ELSE 'claimed' END AS status, CASE WHEN k.id IS NULL THEN s.claimed_by ELSE 'me' END AS claimed_by FROM {D.SOURCE_ROWS} s LEFT JOIN {_CLAIM} k ON k.id = s.id")
def q_claim_applied(spark, d):
    return control.applied(D.source_rows(spark, d), _claimed(spark, d), ["status", "claimed_by", "claimed_at"]).select("id", "status", "claimed_by")


@query("q_claim_budget_sequential", f"SELECT source_name, id FROM (SELECT * FROM {D.THREE} WHERE status = 'pending' ORDER BY source_rank, id LIMIT 1200)")
def q_claim_budget_sequential(spark, d):
    return control.budget(D.three_sources(spark, d).where("status = 'pending'"), "source_rank", "id", 1200).select("source_name", "id")


@query("q_claim_budget_fair", f"SELECT source_name, id FROM (SELECT *, row_number() OVER (PARTITION BY source_rank ORDER BY id) AS turn FROM {D.THREE} WHERE status = 'pending') ORDER BY turn, source_rank LIMIT 1200")
def q_claim_budget_fair(spark, d):
    return control.budget(D.three_sources(spark, d).where("status = 'pending'"), "source_rank", "id", 1200, fair=True).select("source_name", "id")


@query("q_custom_where", f"SELECT id FROM {D.SOURCE_ROWS} WHERE status = 'pending' AND price > 100000 AND created_at <= TIMESTAMP '{NOW}' - INTERVAL 30 DAY")
def q_custom_where(spark, d):
    return D.source_rows(spark, d).where(F.expr("status = 'pending' AND price > 100000")).where(c("created_at") <= ntz(NOW) - F.expr("INTERVAL 30 DAYS")).select("id")


@query("q_mark_packed", f"SELECT id, CASE WHEN status = 'claimed' AND claimed_at IS NOT NULL THEN 'packed' ELSE status END AS status, CASE WHEN status = 'claimed' AND claimed_at IS NOT NULL THEN 'name_' || id END AS des_name, CASE WHEN status = 'claimed' AND claimed_at IS NOT NULL THEN 42 END AS des_container_id FROM {D.SOURCE_ROWS}")
def q_mark_packed(spark, d):
    rows = D.source_rows(spark, d).withColumns({"des_name": lit(None).cast("string"), "des_container_id": lit(None).cast("int")})
    # Ids and names arrive as two arrays; names of rows without a claim time are missing, so pairs end with the shorter array.
    batches = rows.where("status = 'claimed'").select(F.array("id").alias("ids"), F.when(c("claimed_at").isNotNull(), F.array(F.concat(lit("name_"), c("id").cast("string")))).otherwise(F.array().cast("array<string>")).alias("names"))
    pairs = batches.select(F.explode(control.pair_names(c("ids"), c("names"))).alias("p")).select("p.*").withColumn("des_container_id", lit(42))
    return control.mark_packed(rows, pairs, ntz(NOW)).select("id", "status", "des_name", "des_container_id")


@query("q_mark_failed", f"SELECT id, CASE WHEN claimed_by = '5-LOW' THEN 'failed' ELSE status END AS status, CASE WHEN claimed_by = '5-LOW' THEN substr(repeat('x' || id, 200), 1, 500) END AS error_message FROM {D.SOURCE_ROWS}")
def q_mark_failed(spark, d):
    rows = D.source_rows(spark, d).withColumn("error_message", lit(None).cast("string"))
    return control.mark_failed(rows, rows.where("claimed_by = '5-LOW'").select("id", F.repeat(F.concat(lit("x"), c("id").cast("string")), 200).alias("error"))).select("id", "status", "error_message")


@query("q_source_mark_packed", f"SELECT source_name, id, CASE WHEN source_name <> 'part' THEN 'packed' ELSE status END AS status FROM {D.THREE}")
def q_source_mark_packed(spark, d):
    rows = D.three_sources(spark, d)
    marks = rows.where("source_name <> 'part'").select("source_name", "id", lit("packed").alias("_new"))
    return rows.join(marks, ["source_name", "id"], "left").select("source_name", "id", F.coalesce("_new", "status").alias("status"))


@query("q_status_counts", f"SELECT status, count(*) AS n FROM {D.SOURCE_ROWS} GROUP BY ALL")
def q_status_counts(spark, d):
    return metrics.counters(D.source_rows(spark, d), ["status"])


@query("q_multi_source_stats", f"SELECT source_name, status, count(*) AS n FROM {D.THREE} GROUP BY ALL")
def q_multi_source_stats(spark, d):
    return metrics.counters(D.three_sources(spark, d), ["source_name", "status"])


@query("q_source_projection", f"SELECT id, 'b' AS s3_bucket, 'k/' || id AS s3_key, {_SHARD4} AS shard_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created, coalesce(claimed_by, 'none') AS holder, 'erp.orders' AS tbl FROM {D.SOURCE_ROWS}")
def q_source_projection(spark, d):
    meta = F.create_map(lit("source_holder"), c("claimed_by"), lit("created_at"), S.iso_time(c("created_at")))
    rows = D.source_rows(spark, d).select("id", lit("b").alias("s3_bucket"), F.concat(lit("k/"), c("id").cast("string")).alias("s3_key"), S.source_shard(c("shard_key"), c("id"), 4).alias("shard_id"), meta.alias("metadata"))
    return rows.select("id", "s3_bucket", "s3_key", "shard_id", c("metadata")["created_at"].alias("created"), F.coalesce(c("metadata")["source_holder"], lit("none")).alias("holder"), S.table_name(lit("erp"), lit("orders")).alias("tbl"))


# --- locks --------------------------------------------------------------------------------------------

_TTL = f"TIMESTAMP '{EVENTS_NOW}' + INTERVAL 30 SECOND"


@query("q_lock_acquire", f"SELECT shard_id, CASE WHEN wins THEN asks ELSE holder_id END AS holder_id, CASE WHEN wins THEN {_TTL} ELSE expires_at END AS expires_at, CASE WHEN asks IS NOT NULL THEN wins END AS acquired FROM (SELECT l.shard_id, l.holder_id, l.expires_at, r.holder_id AS asks, coalesce(r.holder_id IS NOT NULL AND (l.expires_at < TIMESTAMP '{EVENTS_NOW}' OR l.holder_id = r.holder_id), false) AS wins FROM {D.LOCKS} l LEFT JOIN {D.REQUESTS} r USING (shard_id))")
def q_lock_acquire(spark, d):
    return control.acquire(D.locks(spark, d), D.requests(spark, d), ntz(EVENTS_NOW), 30)


@query("q_lock_renew", f"SELECT shard_id, l.holder_id, CASE WHEN coalesce(r.holder_id = l.holder_id AND expires_at > TIMESTAMP '{EVENTS_NOW}', false) THEN {_TTL} ELSE expires_at END AS expires_at, coalesce(r.holder_id = l.holder_id AND expires_at > TIMESTAMP '{EVENTS_NOW}', false) AS renewed, r.holder_id IS NOT NULL AND NOT coalesce(r.holder_id = l.holder_id AND expires_at > TIMESTAMP '{EVENTS_NOW}', false) AS lost FROM {D.LOCKS} l LEFT JOIN {D.REQUESTS} r USING (shard_id)")
def q_lock_renew(spark, d):
    return control.renew(D.locks(spark, d), D.requests(spark, d), ntz(EVENTS_NOW), 30)


@query("q_lock_release", f"SELECT shard_id, holder_id, expires_at FROM {D.LOCKS} l WHERE NOT EXISTS (SELECT 1 FROM {D.REQUESTS} r WHERE r.shard_id = l.shard_id AND r.holder_id = l.holder_id)")
def q_lock_release(spark, d):
    return control.release(D.locks(spark, d), D.requests(spark, d))


@query("q_expired_locks", f"SELECT shard_id, holder_id, expires_at FROM {D.LOCKS} WHERE expires_at < TIMESTAMP '{LOCKS_NOW}'")
def q_expired_locks(spark, d):
    return D.locks(spark, d).where(P.expired_lock(c("expires_at"), ntz(LOCKS_NOW)))


@query("q_lock_health", f"SELECT count(*) FILTER (expires_at > TIMESTAMP '{EVENTS_NOW}') AS held, count(*) FILTER (expires_at <= TIMESTAMP '{EVENTS_NOW}') AS expired FROM {D.LOCKS}")
def q_lock_health(spark, d):
    return metrics.lock_health(D.locks(spark, d), ntz(EVENTS_NOW))


# --- layout and ranges --------------------------------------------------------------------------------

# A container is a day's shard.
_LAID = f"(SELECT id, key, day, shard_id, size, CAST(16 + coalesce(sum(size) OVER (PARTITION BY day, shard_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS data_offset FROM (SELECT *, {D.sha_bits('key', 2)} AS shard_id FROM {D.FILES}))"


def _laid(spark, d, payload: bool = False):
    files = D.files(spark, d, payload).withColumn("shard_id", S.shard_id(c("key"), 2)).withColumnRenamed("size", "data_length")
    return layout.offsets(files, ["day", "shard_id"], ["id"])


@query("q_archive_layout", f"SELECT id, day, shard_id, size AS data_length, data_offset FROM {_LAID}")
def q_archive_layout(spark, d):
    return _laid(spark, d).select("id", "day", "shard_id", "data_length", "data_offset")


_RANGED = f"(SELECT *, sum(new) OVER (PARTITION BY day, shard_id ORDER BY data_offset, size, key) AS range_id FROM (SELECT *, CASE WHEN before IS NULL OR data_offset - before > 4096 THEN 1 ELSE 0 END AS new FROM (SELECT *, max(data_offset + size) OVER (PARTITION BY day, shard_id ORDER BY data_offset, size, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {_LAID} WHERE id IN (SELECT doc_id FROM labels))))"
_MERGED = f"(SELECT day, shard_id, CAST(range_id AS BIGINT) AS range_id, min(data_offset) AS range_start, max(data_offset + size) AS range_end, count(*) AS members, CAST(sum(size) AS BIGINT) AS wanted_bytes FROM {_RANGED} GROUP BY day, shard_id, range_id)"


def _requested(spark, d):
    """The members asked for: those with a label."""
    return D.table(spark, d, "labels").select(c("doc_id").alias("id"))


def _wanted(spark, d):
    return _laid(spark, d).join(_requested(spark, d), "id", "left_semi")


@query("q_range_merge", f"SELECT * FROM {_MERGED}")
def q_range_merge(spark, d):
    return layout.merge_ranges(_wanted(spark, d), ["day", "shard_id"], tie="key", max_gap=4096)


@query("q_range_members", f"SELECT id, CAST(range_id AS BIGINT) AS range_id, CAST(data_offset - min(data_offset) OVER (PARTITION BY day, shard_id, range_id) AS BIGINT) AS offset_in_range FROM {_RANGED}")
def q_range_members(spark, d):
    own = layout.grouped_ranges(_wanted(spark, d), ["day", "shard_id"], tie="key", max_gap=4096)
    return own.select("id", "range_id", (c("data_offset") - F.min("data_offset").over(Window.partitionBy("day", "shard_id", "range_id"))).alias("offset_in_range"))


@query("q_range_amplification", f"SELECT day, count(*) AS ranges, CAST(sum(range_end - range_start) AS BIGINT) AS read_bytes, CAST(sum(wanted_bytes) AS BIGINT) AS wanted_bytes, round(CAST(sum(range_end - range_start) AS DOUBLE) / CAST(sum(wanted_bytes) AS DOUBLE), 6) AS amplification FROM {_MERGED} GROUP BY day")
def q_range_amplification(spark, d):
    m = layout.merge_ranges(_wanted(spark, d), ["day", "shard_id"], tie="key", max_gap=4096)
    return m.groupBy("day").agg(F.count(lit(1)).alias("ranges"), F.sum(c("range_end") - c("range_start")).alias("read_bytes"), F.sum("wanted_bytes").alias("wanted_bytes")).withColumn("amplification", F.round(c("read_bytes").cast("double") / c("wanted_bytes"), 6))


@query("q_range_slices", f"SELECT id, sha256(text) AS digest FROM {D.FILES} WHERE id IN (SELECT doc_id FROM labels)")
def q_range_slices(spark, d):
    """Cut every requested member out of the bytes of its merged range, gaps and the members in them included."""
    at = ["day", "shard_id"]
    laid = _laid(spark, d, payload=True)
    own = layout.grouped_ranges(_wanted(spark, d), at, tie="key", max_gap=4096)
    ranges = layout.merge_ranges(_wanted(spark, d), at, tie="key", max_gap=4096).select(*at, "range_id", "range_start", "range_end")
    inside = laid.alias("m").join(ranges.alias("r"), [c("m.day") == c("r.day"), c("m.shard_id") == c("r.shard_id"), c("m.data_offset") >= c("r.range_start"), c("m.data_offset") + c("m.data_length") <= c("r.range_end")])
    buffers = inside.groupBy("r.day", "r.shard_id", "range_id", "range_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("data_offset", "data_length", "id", "text"))), lambda x: x["text"]), "").cast("binary").alias("buffer"))
    return layout.slice_members(buffers, own.select(*at, "range_id", "id", "data_offset", "data_length"), [*at, "range_id"]).select("id", F.sha2("data", 256).alias("digest"))


_STATS = f"(SELECT container, count(*) AS total_files, count(*) FILTER (flags = 0) AS internal_files, count(*) FILTER (flags = 1) AS external_files, CAST(coalesce(sum(data_length) FILTER (flags = 0), 0) AS BIGINT) AS internal_size_bytes, CAST(coalesce(sum(data_length) FILTER (flags = 1), 0) AS BIGINT) AS external_size_bytes FROM {D.MEMBERS} GROUP BY container)"


@query("q_archive_stats", f"SELECT *, internal_size_bytes + 88 AS archive_size_bytes, internal_size_bytes + external_size_bytes AS total_size_bytes, CASE WHEN internal_size_bytes = 0 THEN 0.0::DOUBLE ELSE round((internal_size_bytes + 88)::DOUBLE / internal_size_bytes::DOUBLE, 9) END AS compression_ratio FROM {_STATS}")
def q_archive_stats(spark, d):
    s = layout.stats(D.members(spark, d), ["container"]).withColumn("archive_size_bytes", c("internal_size_bytes") + 88)
    return layout.derived(s).withColumn("compression_ratio", F.round("compression_ratio", 9))


@query("q_writer_stats", "SELECT user_id, count(*) AS entry_count, count(DISTINCT event_type) AS distinct_count, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY user_id")
def q_writer_stats(spark, d):
    return D.table(spark, d, "events").groupBy("user_id").agg(F.count(lit(1)).alias("entry_count"), F.count_distinct("event_type").alias("distinct_count"), F.sum(F.octet_length("props").cast("long")).alias("bytes"))


_MO = ", ".join(D.MEMBER_ORDER)


@query("q_container_totals", f"SELECT container, l_partkey, l_suppkey, data_length, count(*) OVER w AS file_count, CAST(sum(data_length) OVER w AS BIGINT) AS data_bytes FROM {D.MEMBERS} WINDOW w AS (PARTITION BY container ORDER BY {_MO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def q_container_totals(spark, d):
    return layout.running_totals(D.members(spark, d), ["container"], D.MEMBER_ORDER).select("container", "l_partkey", "l_suppkey", "data_length", "file_count", "data_bytes")


def _human_sql(x):
    steps = " ".join(f"WHEN {x} < {float(1024 ** (i + 1))} THEN printf('%.1f{u}', {x} / {float(1024**i)})" for i, u in enumerate(("B", "KB", "MB", "GB", "TB")))
    return f"CASE {steps} ELSE printf('%.1fPB', {x} / {float(1024**5)}) END"


@query("q_human_size", f"SELECT id, {_human_sql('CAST(size * size AS DOUBLE)')} AS human FROM {D.FILES}")
def q_human_size(spark, d):
    return D.files(spark, d).select("id", S.human_size(c("size") * c("size")).alias("human"))


_FLAG = "CAST(quality + 2 * toxic AS BIGINT)"


@query("q_internal_only", "SELECT doc_id FROM labels WHERE quality = 0")
def q_internal_only(spark, d):
    return D.table(spark, d, "labels").withColumn("flags", c("quality").cast("long")).where(~P.is_external(c("flags"))).select("doc_id")


@query("q_index_repr", f"SELECT doc_id, 'IndexEntry(name=''' || doc_id || '.txt'', data_offset=' || doc_id * 10 || ', data_length=' || strlen(text) || CASE WHEN {_FLAG} = 0 THEN '' ELSE ' [' || concat_ws(',', CASE WHEN {_FLAG} & 1 <> 0 THEN 'EXTERNAL' END, CASE WHEN {_FLAG} & 2 <> 0 THEN 'COMPRESSED' END) || ']' END || ')' AS repr FROM documents JOIN labels USING (doc_id)")
def q_index_repr(spark, d):
    j = D.table(spark, d, "documents").join(D.table(spark, d, "labels"), "doc_id")
    return j.select("doc_id", layout.entry_text(F.concat(c("doc_id").cast("string"), lit(".txt")), c("doc_id") * 10, F.octet_length("text"), (c("quality") + 2 * c("toxic")).cast("long")).alias("repr"))


@query("q_external_members", "SELECT d.doc_id, 'arc/_bigFiles/' || d.doc_id || '.txt' AS external_key, CAST(strlen(text) AS BIGINT) AS size, 'external' AS part FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 UNION ALL SELECT d.doc_id, NULL, CAST(strlen(text) AS BIGINT), 'internal' FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0")
def q_external_members(spark, d):
    j = D.table(spark, d, "documents").join(D.table(spark, d, "labels"), "doc_id").withColumn("flags", c("quality").cast("long"))
    name = F.concat(c("doc_id").cast("string"), lit(".txt"))
    ext = j.where(P.is_external(c("flags"))).select("doc_id", S.external_key("arc", name).alias("external_key"), F.octet_length("text").cast("long").alias("size"), lit("external").alias("part"))
    own = j.where(~P.is_external(c("flags"))).select("doc_id", lit(None).cast("string").alias("external_key"), F.octet_length("text").cast("long").alias("size"), lit("internal").alias("part"))
    return ext.unionByName(own)


@query("q_externalise", f"SELECT id, size >= 4000 OR id % 50 = 0 AS external FROM {D.FILES}")
def q_externalise(spark, d):
    return D.files(spark, d).select("id", P.externalise(c("size"), c("id") % 50 == 0, threshold=4000).alias("external"))


# --- membership ---------------------------------------------------------------------------------------


@query("q_contains", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT event_id * 3 FROM events)")
def q_contains(spark, d):
    names = D.table(spark, d, "events").select((c("event_id") * 3).alias("doc_id"))
    return D.table(spark, d, "documents").select("doc_id").join(names, "doc_id", "left_semi")


@query("q_missing_names", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents)")
def q_missing_names(spark, d):
    asked = D.table(spark, d, "events").select("event_id")
    return asked.join(D.table(spark, d, "documents").select(c("doc_id").alias("event_id")), "event_id", "left_anti")


@query("q_last_wins", "SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def q_last_wins(spark, d):
    e = D.table(spark, d, "events").select("user_id", "event_type", "event_id", "value", c("event_id").alias("ordinal"))
    return layout.last_wins(e, ["user_id", "event_type"], "ordinal").select("user_id", "event_type", "event_id", "value")


# --- keys ---------------------------------------------------------------------------------------------


@query("q_filename_valid", "SELECT page_id, regexp_matches(url, '[/\\\\:*?\"<>|]') = false AND strlen(url) BETWEEN 1 AND 65535 AS url_ok, true AS base_ok FROM pages")
def q_filename_valid(spark, d):
    return D.table(spark, d, "pages").select("page_id", P.valid_name(c("url")).alias("url_ok"), P.valid_name(F.concat(lit("p"), c("page_id").cast("string"), lit(".html"))).alias("base_ok"))


@query("q_basename", "SELECT page_id, split_part(url, '/', -1) AS base, CASE WHEN contains(url, '/') THEN left(url, length(url) - length(split_part(url, '/', -1)) - 1) ELSE '' END AS parent FROM pages")
def q_basename(spark, d):
    return D.table(spark, d, "pages").select("page_id", S.basename(c("url")).alias("base"), S.parent_prefix(c("url")).alias("parent"))


@query("q_container_key", f"SELECT id, 'arc/' || strftime(day, '%Y-%m-%d') || '/shard_' || printf('%02d', s) || '.des' AS container_key FROM (SELECT *, {D.sha_bits('key', 8)} AS s FROM {D.FILES})")
def q_container_key(spark, d):
    return D.files(spark, d).select("id", S.container_key("arc", c("day"), S.shard_id(c("key"), 8)).alias("container_key"))


@query("q_shard_hex", f"SELECT id, lower(lpad(to_hex({D.sha_bits('key', 10)}), 3, '0')) AS label FROM {D.FILES}")
def q_shard_hex(spark, d):
    return D.files(spark, d).select("id", S.shard_hex(S.shard_id(c("key"), 10), 10).alias("label"))


@query("q_external_key", f"SELECT id, bucket || '/_bigFiles/' || id || '.txt' AS external_key FROM {D.FILES}")
def q_external_key(spark, d):
    return D.files(spark, d).select("id", S.external_key(c("bucket"), F.concat(c("id").cast("string"), lit(".txt"))).alias("external_key"))


@query("q_upload_keys", "SELECT page_id, 'base/' || ltrim(k, '/') AS uploaded, CASE WHEN starts_with(k, 'base/') THEN k ELSE 'base/' || ltrim(k, '/') END AS full_key FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'base/' || page_id WHEN 1 THEN '/x/' || page_id ELSE 'y/' || page_id END AS k FROM pages)")
def q_upload_keys(spark, d):
    i = c("page_id")
    k = F.concat(F.when(i % 3 == 0, "base/").when(i % 3 == 1, "/x/").otherwise("y/"), i.cast("string"))
    return D.table(spark, d, "pages").select("page_id", S.upload_key(k, "base").alias("uploaded"), S.full_key(k, "base").alias("full_key"))


@query("q_cache_keys", "SELECT page_id, 'DES:' || url || ':' || strlen(html) || ':' || page_id || ':1' AS local_key, 'bkt/' || url || '/' || page_id AS remote_key FROM pages")
def q_cache_keys(spark, d):
    return D.table(spark, d, "pages").select("page_id", S.local_cache_key(c("url"), F.octet_length("html"), c("page_id")).alias("local_key"), S.remote_cache_key(lit("bkt"), c("url"), c("page_id").cast("string")).alias("remote_key"))


@query("q_headers", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamped, CAST(user_id AS VARCHAR) AS x_shard, CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END AS x_external, CAST(strlen(props) AS VARCHAR) AS x_size FROM events")
def q_headers(spark, d):
    return D.table(spark, d, "events").select("event_id", S.iso_time(c("ts")).alias("stamped"), c("user_id").cast("string").alias("x_shard"), (c("event_type") == "error").cast("string").alias("x_external"), F.octet_length("props").cast("string").alias("x_size"))


@query("q_meta_json", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '{\"size\":' || strlen(props) || ',\"is_external\":true,\"external_key\":\"arc/_bigFiles/' || event_id || '\"}' ELSE '{\"size\":' || strlen(props) || '}' END AS meta FROM events")
def q_meta_json(spark, d):
    return D.table(spark, d, "events").select("event_id", layout.enriched_meta(F.octet_length("props"), c("user_id") % 2 == 0, S.external_key("arc", c("event_id").cast("string"))).alias("meta"))


@query("q_meta_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_meta_extract(spark, d):
    return D.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("q_meta_override", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'mine' ELSE 'src' END AS source_name, event_type AS kind, CAST(CASE WHEN user_id % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) AS n_keys FROM events")
def q_meta_override(spark, d):
    """Provenance keys first, then the source's own metadata, which overrides them: a map built from distinct keys, whatever the session's policy on repeated ones."""
    base = F.create_map(lit("source_name"), lit("src"), lit("kind"), c("event_type"))
    own = F.when(c("user_id") % 2 == 0, F.create_map(lit("source_name"), lit("mine"), lit("extra"), lit("1"))).otherwise(F.create_map().cast("map<string,string>"))
    m = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)
    return D.table(spark, d, "events").select("event_id", m.alias("m")).select("event_id", c("m")["source_name"].alias("source_name"), c("m")["kind"].alias("kind"), F.size("m").alias("n_keys"))


# --- recovery -----------------------------------------------------------------------------------------


@query("q_stale_claims", f"SELECT id FROM {D.SOURCE_ROWS} WHERE status = 'claimed' AND (claimed_at IS NULL OR claimed_at < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND)")
def q_stale_claims(spark, d):
    return recovery.release_stale(D.source_rows(spark, d), ntz(NOW))[1].select("id")


@query("q_stale_released", f"SELECT id, CASE WHEN stale THEN 'pending' ELSE status END AS status, CASE WHEN NOT stale THEN claimed_by END AS claimed_by FROM (SELECT *, status = 'claimed' AND (claimed_at IS NULL OR claimed_at < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND) AS stale FROM {D.SOURCE_ROWS})")
def q_stale_released(spark, d):
    return recovery.release_stale(D.source_rows(spark, d), ntz(NOW))[0].select("id", "status", "claimed_by")


_JOINED = f"(SELECT k.*, o.valid, o.file_count AS actual FROM {D.CONTAINERS} k LEFT JOIN {D.OBJECTS} o ON o.key = k.s3_key)"


@query("q_partial_containers", f"SELECT id, CASE WHEN coalesce(valid, false) THEN 'uploaded' ELSE 'failed' END AS new_status, CASE WHEN valid IS NULL THEN 'missing' WHEN valid THEN 'complete' ELSE 'invalid' END AS reason FROM {_JOINED} WHERE status = 'writing' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 900 SECOND")
def q_partial_containers(spark, d):
    return recovery.settle_partial(D.containers(spark, d), D.objects(spark, d), ntz(NOW)).select("id", "new_status", "reason")


@query("q_integrity", f"SELECT id, CASE WHEN valid IS NULL THEN 'missing' WHEN NOT valid THEN 'invalid' ELSE 'count_mismatch' END AS issue FROM {_JOINED} WHERE status = 'uploaded' AND (valid IS NULL OR NOT valid OR actual <> file_count)")
def q_integrity(spark, d):
    return recovery.integrity(D.containers(spark, d), D.objects(spark, d)).select("id", "issue")


_LISTED = "(SELECT CASE WHEN page_id % 10 = 0 THEN 'arc/_bigFiles/' || page_id ELSE 'arc/' || page_id * 3 || '.des' END AS key, strlen(html) AS size FROM pages)"


def _listed(spark, d):
    i = c("page_id")
    return D.table(spark, d, "pages").select(F.when(i % 10 == 0, F.concat(lit("arc/_bigFiles/"), i.cast("string"))).otherwise(F.concat(lit("arc/"), (i * 3).cast("string"), lit(".des"))).alias("key"), F.octet_length("html").alias("size"))


_ORPHANS = f"(SELECT key FROM {_LISTED} WHERE NOT contains(key, '_bigFiles/') AND key NOT IN (SELECT s3_key FROM {D.CONTAINERS} WHERE status = 'uploaded'))"


@query("q_orphans", f"SELECT key FROM {_ORPHANS}")
def q_orphans(spark, d):
    return recovery.orphans(_listed(spark, d), D.containers(spark, d).where("status = 'uploaded'")).select("key")


@query("q_orphan_plan", f"SELECT 'delete' AS action, key FROM {_ORPHANS}")
def q_orphan_plan(spark, d):
    return recovery.deletion_plan(recovery.orphans(_listed(spark, d), D.containers(spark, d).where("status = 'uploaded'")))


@query("q_object_heads", f"SELECT k.id, o.key IS NOT NULL AS found, o.size AS size FROM {D.CONTAINERS} k LEFT JOIN (SELECT key, CAST(size AS BIGINT) AS size FROM {_LISTED}) o ON o.key = k.s3_key")
def q_object_heads(spark, d):
    heads = _listed(spark, d).select(c("key").alias("s3_key"), c("size").cast("long").alias("size"), lit(True).alias("_hit"))
    return D.containers(spark, d).join(heads, "s3_key", "left").select("id", F.coalesce("_hit", lit(False)).alias("found"), "size")


@query("q_recovery_sweep", f"""SELECT 'release_claim' AS action, CAST(id AS VARCHAR) AS key FROM {D.SOURCE_ROWS} WHERE status = 'claimed' AND (claimed_at IS NULL OR claimed_at < TIMESTAMP '{EVENTS_NOW}' - INTERVAL 300 SECOND)
UNION ALL SELECT 'release_lock', CAST(shard_id AS VARCHAR) FROM {D.LOCKS} WHERE expires_at < TIMESTAMP '{EVENTS_NOW}'
UNION ALL SELECT CASE WHEN coalesce(valid, false) THEN 'container_uploaded' ELSE 'container_failed' END, CAST(id AS VARCHAR) FROM {_JOINED} WHERE status = 'writing' AND created_at < TIMESTAMP '{EVENTS_NOW}' - INTERVAL 900 SECOND
UNION ALL SELECT 'integrity_' || CASE WHEN valid IS NULL THEN 'missing' WHEN NOT valid THEN 'invalid' ELSE 'count_mismatch' END, CAST(id AS VARCHAR) FROM {_JOINED} WHERE status = 'uploaded' AND (valid IS NULL OR NOT valid OR actual <> file_count)
UNION ALL SELECT 'delete', key FROM {D.OBJECTS} WHERE key NOT IN (SELECT s3_key FROM {D.CONTAINERS})""")
def q_recovery_sweep(spark, d):
    return recovery.sweep(D.source_rows(spark, d), D.locks(spark, d), D.containers(spark, d), D.objects(spark, d), ntz(EVENTS_NOW))


# --- container records --------------------------------------------------------------------------------


@query("q_container_insert", f"SELECT (SELECT max(id) FROM {D.CONTAINERS}) + row_number() OVER (ORDER BY day, shard_id, s3_key) AS id, shard_id, day, 'writing' AS status, s3_key FROM (SELECT CAST(s AS INTEGER) AS shard_id, day, 'new/' || strftime(day, '%Y-%m-%d') || '/' || s AS s3_key FROM (SELECT DISTINCT {D.sha_bits('key', 3)} AS s, day FROM {D.FILES}))")
def q_container_insert(spark, d):
    new = D.files(spark, d).select(S.shard_id(c("key"), 3).cast("int").alias("shard_id"), "day").distinct().withColumn("s3_key", F.concat(lit("new/"), F.date_format("day", "yyyy-MM-dd"), lit("/"), c("shard_id").cast("string")))
    return control.insert_containers(D.containers(spark, d), new, ntz(NOW)).select("id", "shard_id", "day", "status", "s3_key")


@query("q_container_update", f"SELECT id, CASE WHEN status = 'writing' THEN 'uploaded' ELSE status END AS status, CASE WHEN status = 'writing' THEN TIMESTAMP '{NOW}' END AS finalized_at FROM {D.CONTAINERS}")
def q_container_update(spark, d):
    k = D.containers(spark, d).withColumn("finalized_at", lit(None).cast("timestamp_ntz"))
    return control.finalise(k, k.where("status = 'writing'"), ntz(NOW)).select("id", "status", "finalized_at")


@query("q_container_latest", f"SELECT shard_id, day, arg_max(id, (created_at, id)) AS id, arg_max(status, (created_at, id)) AS status FROM {D.CONTAINERS} GROUP BY ALL")
def q_container_latest(spark, d):
    return control.latest(D.containers(spark, d), ["shard_id", "day"], ["created_at", "id"]).select("shard_id", "day", "id", "status")


# --- metrics ------------------------------------------------------------------------------------------

_CENTS = "CAST(round(value * 100) AS BIGINT)"


def _latencies(spark, d):
    return D.table(spark, d, "events").withColumns({"cents": F.round(c("value") * 100).cast("long"), "error": F.when(c("event_type") == "error", F.concat(lit("E"), (c("user_id") % 3).cast("string")))})


@query("q_marker_stats", f"SELECT user_id % 10 AS worker, count(*) AS attempts, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, min({_CENTS}) AS min_latency, max({_CENTS}) AS max_latency, round(CAST(sum({_CENTS}) AS DOUBLE) / count(*), 6) AS avg_latency, count(*) FILTER (event_type = 'error' AND user_id % 3 = 1) AS e1 FROM events GROUP BY ALL")
def q_marker_stats(spark, d):
    s = metrics.batch_stats(_latencies(spark, d).withColumn("worker", c("user_id") % 10), ["worker"], "cents", "error")
    return s.withColumns({"avg_latency": F.round("avg_latency", 6), "e1": F.coalesce(c("error_breakdown")["E1"], lit(0)).cast("long")}).drop("error_breakdown")


_BOUNDS = metrics.ENTRY_MILLISECONDS
_HIST = f"(SELECT event_type, le, count(*) FILTER (value <= le) AS count FROM events, (SELECT unnest([{', '.join(str(b) for b in _BOUNDS)}, 'inf'::DOUBLE]) AS le) GROUP BY ALL)"


@query("q_latency_histogram", f"SELECT event_type, CAST(le AS DOUBLE) AS le, count FROM {_HIST}")
def q_latency_histogram(spark, d):
    return metrics.histogram(D.table(spark, d, "events"), "value", _BOUNDS, ["event_type"])


@query("q_latency_p95", f"SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / (count - below) END, 9) AS p95 FROM (SELECT *, lag(CAST(le AS DOUBLE), 1, 0.0) OVER w AS low, lag(count, 1, 0) OVER w AS below, 0.95 * max(count) OVER (PARTITION BY event_type) AS rank FROM {_HIST} WINDOW w AS (PARTITION BY event_type ORDER BY le)) WHERE count >= rank AND below < rank")
def q_latency_p95(spark, d):
    h = metrics.histogram(D.table(spark, d, "events"), "value", _BOUNDS, ["event_type"])
    return metrics.quantile(h, 0.95, ["event_type"]).select("event_type", F.round("quantile", 9).alias("p95"))


@query("q_counters", f"SELECT event_type, count(*) AS n, CAST(sum({_CENTS}) AS BIGINT) AS cents FROM events GROUP BY ALL")
def q_counters(spark, d):
    return metrics.counters(_latencies(spark, d), ["event_type"], cents="cents")


@query("q_summary", f"SELECT count(value) AS n, CAST(sum({_CENTS}) AS BIGINT) AS cents FROM events")
def q_summary(spark, d):
    return _latencies(spark, d).agg(F.count("value").alias("n"), F.sum("cents").alias("cents"))


@query("q_rates", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, round(count(*) / 300.0, 9)::DOUBLE AS rate FROM events GROUP BY ALL")
def q_rates(spark, d):
    return metrics.rates(D.table(spark, d, "events"), "ts", "5 minutes", ["event_type"], 300.0).withColumn("rate", F.round("rate", 9))


@query("q_health_report", f"SELECT CASE WHEN enabled - connected > 3 THEN 'unhealthy' WHEN expired > 0 OR connected < enabled THEN 'degraded' ELSE 'healthy' END AS status, expired, enabled, connected FROM (SELECT (SELECT count(*) FROM {D.LOCKS} WHERE expires_at <= TIMESTAMP '{EVENTS_NOW}') AS expired, count(*) AS enabled, count(*) FILTER (last <> 'error') AS connected FROM (SELECT user_id % 20 AS s, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY ALL))")
def q_health_report(spark, d):
    last = D.table(spark, d, "events").groupBy((c("user_id") % 20).cast("string").alias("source")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    s = metrics.source_health(last.select("source", lit(True).alias("enabled"), F.when(c("last") == "error", "error").otherwise("ok").alias("status")))
    j = metrics.lock_health(D.locks(spark, d), ntz(EVENTS_NOW)).join(F.broadcast(s))  # one row each
    return j.select(metrics.overall_health(c("enabled") - c("connected") <= 3, lit(True), c("expired"), lit(True), c("connected"), c("enabled")).alias("status"), "expired", "enabled", "connected")


@query("q_endpoint_snapshot", f"SELECT user_id AS id, coalesce(ok, false) OR coalesce(last < TIMESTAMP '{EVENTS_NOW}' - INTERVAL 30 SECOND, false) AS healthy FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) <> 'error' AS ok, max(ts) FILTER (event_type = 'error') AS last FROM events GROUP BY user_id)")
def q_endpoint_snapshot(spark, d):
    e = D.table(spark, d, "events").groupBy(c("user_id").alias("id")).agg((F.max_by("event_type", F.struct("ts", "event_id")) != "error").alias("is_healthy"), F.max(F.when(c("event_type") == "error", c("ts"))).alias("last_failure_time"))
    return metrics.endpoint_snapshot(routing.healthy_now(e, ntz(EVENTS_NOW)))


@query("q_cache_stats", f"SELECT count(*) AS entries, count(*) FILTER (expires_at < TIMESTAMP '{EVENTS_NOW}') AS expired, count(*) FILTER (expires_at >= TIMESTAMP '{EVENTS_NOW}') AS active FROM {D.LOCKS}")
def q_cache_stats(spark, d):
    return metrics.cache_stats(D.locks(spark, d).withColumnRenamed("expires_at", "expiry"), ntz(EVENTS_NOW))


# --- routing, limits, retries -------------------------------------------------------------------------

_SECONDS = "(epoch_us(ts) / 1000000.0)::DOUBLE"


@query("q_rate_limit_schedule", f"SELECT event_id, round(greatest(a, coalesce(slack + (k - 1) * 1800.0 - 3600.0, a)), 3)::DOUBLE AS release FROM (SELECT *, max(a - (k - 1) * 1800.0) OVER (PARTITION BY lim ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS slack FROM (SELECT event_id, ts, user_id % 8 AS lim, {_SECONDS} AS a, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id)::DOUBLE AS k FROM events))")
def q_rate_limit_schedule(spark, d):
    e = D.table(spark, d, "events").select("event_id", "ts", (c("user_id") % 8).alias("lim"), (F.unix_micros(c("ts").cast("timestamp")) / 1000000.0).alias("a"))
    return routing.token_bucket(e, ["lim"], ["ts", "event_id"], "a", 1800.0, 3).select("event_id", F.round("release", 3).alias("release"))


@query("q_retry_schedule", "SELECT event_id, pow(2.0, a) AS client_wait, pow(2.0, a - 1) AS marker_wait, least(pow(2.0, a - 1), 3.0)::DOUBLE AS router_wait, CAST(greatest(a - 2, 1) AS BIGINT) AS calls FROM (SELECT event_id, event_id % 6 + 1 AS a FROM events)")
def q_retry_schedule(spark, d):
    a = c("event_id") % 6 + 1
    return D.table(spark, d, "events").select("event_id", S.retry_wait(a).alias("client_wait"), S.retry_wait(a - 1).alias("marker_wait"), S.router_wait(a).alias("router_wait"), S.attempts_made(a - 2).alias("calls"))


_MSG = "CASE event_id % 5 WHEN 0 THEN 'Deadlock detected' WHEN 1 THEN 'Read TIMEOUT' WHEN 2 THEN 'database is locked' WHEN 3 THEN 'no such table' END"


@query("q_retry_classify", f"SELECT event_id, coalesce(regexp_matches(lower(m), 'timeout|connection|deadlock|lock|temporary'), false) AS marker, coalesce(s IN ('40P01', '55P03', '40001'), false) OR coalesce(regexp_matches(lower(m), 'deadlock detected|could not obtain lock|lock wait timeout|timeout expired|could not serialize access|serialization failure|database is locked'), false) AS db, st IN (500, 503) OR upper(cd) IN ('500', '503', '429', 'REQUESTTIMEOUT', 'TOOMANYREQUESTS') AS store FROM (SELECT event_id, {_MSG} AS m, CASE WHEN event_id % 7 = 0 THEN '40001' END AS s, CAST(498 + event_id % 6 AS INTEGER) AS st, CASE event_id % 3 WHEN 0 THEN 'RequestTimeout' WHEN 1 THEN 'NoSuchKey' ELSE '429' END AS cd FROM events)")
def q_retry_classify(spark, d):
    i = c("event_id")
    msg = F.when(i % 5 == 0, "Deadlock detected").when(i % 5 == 1, "Read TIMEOUT").when(i % 5 == 2, "database is locked").when(i % 5 == 3, "no such table")
    code = F.when(i % 3 == 0, "RequestTimeout").when(i % 3 == 1, "NoSuchKey").otherwise("429")
    return D.table(spark, d, "events").select("event_id", P.retryable(msg).alias("marker"), P.retryable_db(F.when(i % 7 == 0, "40001"), msg).alias("db"), P.retryable_store((498 + i % 6).cast("int"), code).alias("store"))


_BYTE = "CASE event_id % 4 WHEN 0 THEN CAST(event_id - 5000 AS INTEGER) WHEN 1 THEN CAST(CAST('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 2) AS BIGINT) AS INTEGER) WHEN 2 THEN 171 ELSE 26 END"
_ROUTED = f"(SELECT r.event_id, r.hash_byte, p.id AS primary_id, CASE WHEN p.healthy THEN p.id ELSE (SELECT min_by(id, place) FROM {D.ENDPOINTS} WHERE healthy) END AS target_id FROM (SELECT event_id, {_BYTE} AS hash_byte FROM events) r JOIN {D.ENDPOINTS} p ON p.place = ((r.hash_byte % 5) + 5) % 5)"


def _routed(spark, d):
    i = c("event_id")
    param = F.when(i % 4 == 0, (i - 5000).cast("string")).when(i % 4 == 3, "0x1A")
    given = F.when(i % 4 == 2, "aBcd")
    byte = S.hash_byte(c("user_id").cast("string"), given, param)
    return routing.route(D.table(spark, d, "events").select("event_id", "user_id"), D.endpoints(spark), byte)


@query("q_route_primary", f"SELECT event_id, hash_byte, primary_id, target_id FROM {_ROUTED}")
def q_route_primary(spark, d):
    return _routed(spark, d).select("event_id", "hash_byte", "primary_id", "target_id")


@query("q_route_fallback", f"SELECT event_id, target_id, (SELECT string_agg(id, ',' ORDER BY place) FROM {D.ENDPOINTS} e WHERE healthy AND e.id <> r.target_id) AS fallbacks FROM {_ROUTED} r")
def q_route_fallback(spark, d):
    return _routed(spark, d).select("event_id", "target_id", F.array_join("fallback_ids", ",").alias("fallbacks"))


@query("q_round_robin", "SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id % 6 ORDER BY ts, event_id) - 1) % 3 AS INTEGER) AS turn FROM events")
def q_round_robin(spark, d):
    e = D.table(spark, d, "events").select("event_id", "ts", (c("user_id") % 6).alias("router"))
    return routing.round_robin(e, ["ts", "event_id"], 3, ["router"]).select("event_id", c("turn").cast("int").alias("turn"))


@query("q_round_robin_global", "SELECT event_id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) % 3 AS INTEGER) AS turn FROM events")
def q_round_robin_global(spark, d):
    e = D.table(spark, d, "events").select("event_id", "ts")
    return routing.round_robin(e, ["ts", "event_id"], 3, bucket=F.to_date("ts")).select("event_id", c("turn").cast("int").alias("turn"))


@query("q_breaker_runs", "SELECT user_id, count(*) AS run_length, min(ts) AS first_ts, min(event_id) AS first_event_id FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events) WHERE event_type = 'error' GROUP BY user_id, island HAVING count(*) >= 2")
def q_breaker_runs(spark, d):
    e = D.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return routing.failure_runs(e, ["user_id"], ["ts", "event_id"], c("event_type") == "error").where("run_length >= 2")


_TIMED = """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, false AS found_open, CASE WHEN bad THEN 1 ELSE 0 END AS failures, CASE WHEN bad AND 1 >= 2 THEN us END AS opened FROM o WHERE k = 1
UNION ALL SELECT user_id, event_id, k, p_open IS NOT NULL, CASE WHEN bad THEN p_n + 1 ELSE 0 END, CASE WHEN bad AND p_n + 1 >= 2 THEN us WHEN bad THEN p_open END FROM (SELECT o.*, CASE WHEN r.opened IS NOT NULL AND o.us - r.opened > 43200000000 THEN 0 ELSE r.failures END AS p_n, CASE WHEN r.opened IS NOT NULL AND o.us - r.opened > 43200000000 THEN NULL ELSE r.opened END AS p_open FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1))
SELECT event_id, found_open, CAST(failures AS BIGINT) AS failures FROM r"""


@query("q_breaker_timed", _TIMED)
def q_breaker_timed(spark, d):
    e = D.table(spark, d, "events").select("user_id", "event_id", F.unix_micros(c("ts").cast("timestamp")).alias("us"), (c("event_type") == "error").alias("bad"))
    return routing.breaker_states(e, "user_id", ["us", "event_id"], "us", "bad", 2, 43_200_000_000).select("event_id", "found_open", "failures")


# --- caches -------------------------------------------------------------------------------------------

_LRU = "(SELECT event_id, user_id AS key, user_id % 16 AS cache_id FROM events)"


@query("q_lru_hits", f"SELECT a.event_id, p.prev IS NOT NULL AND (SELECT count(DISTINCT b.key) FROM {_LRU} b WHERE b.cache_id = a.cache_id AND b.event_id > p.prev AND b.event_id < a.event_id) < 4 AS hit FROM {_LRU} a JOIN (SELECT event_id, lag(event_id) OVER (PARTITION BY cache_id, key ORDER BY event_id) AS prev FROM {_LRU}) p USING (event_id)")
def q_lru_hits(spark, d):
    e = D.table(spark, d, "events").select("event_id", c("user_id").alias("key"), (c("user_id") % 16).alias("cache_id"))
    return cachesim.lru_hits(e, "cache_id", ["event_id"], "key", 4).select("event_id", "hit")


@query("q_ttl_hits", """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, us AS set_at, false AS hit FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.us - r.set_at <= 86400000000 THEN r.set_at ELSE o.us END, o.us - r.set_at <= 86400000000 FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT event_id, hit FROM r""")
def q_ttl_hits(spark, d):
    e = D.table(spark, d, "events").select("event_id", c("user_id").alias("key"), (c("user_id") % 16).alias("cache_id"), F.unix_micros(c("ts").cast("timestamp")).alias("us"))
    return cachesim.ttl_hits(e, "cache_id", ["us", "event_id"], "key", "us", 86_400_000_000).select("event_id", "hit")


# --- days and checkpoints -----------------------------------------------------------------------------


@query("q_day_rollover", "SELECT user_id, event_id, before AS closes_day, day FROM (SELECT user_id, event_id, CAST(ts AS DATE) AS day, lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> day")
def q_day_rollover(spark, d):
    e = D.table(spark, d, "events").select("user_id", "event_id", "ts", F.to_date("ts").alias("day"))
    return control.rollovers(e, ["user_id"], ["ts", "event_id"], "day").select("user_id", "event_id", "closes_day", "day")


@query("q_checkpoint_count", "SELECT user_id, event_id, n AS file_count, n % 10 = 0 AS checkpoint FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS n FROM events)")
def q_checkpoint_count(spark, d):
    e = D.table(spark, d, "events").select("user_id", "event_id", "ts")
    return control.checkpoints(e, ["user_id"], ["ts", "event_id"], 10).select("user_id", "event_id", c("file_count").cast("long").alias("file_count"), "checkpoint")


_CHECKPOINTS = """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, us AS last, false AS checkpoint FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.k % 10 = 0 OR o.us - r.last >= 43200000000 THEN o.us ELSE r.last END, o.k % 10 = 0 OR o.us - r.last >= 43200000000 FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT event_id, checkpoint FROM r"""


@query("q_checkpoint_timed", _CHECKPOINTS)
def q_checkpoint_timed(spark, d):
    e = D.table(spark, d, "events").select("user_id", "event_id", F.unix_micros(c("ts").cast("timestamp")).alias("us"))
    return control.checkpoints_timed(e, "user_id", ["us", "event_id"], "us", 10, 43_200_000_000).select("event_id", "checkpoint")


@query("q_daily_window", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def q_daily_window(spark, d):
    return D.table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "n")


_REPLAY = """WITH RECURSIVE o AS (SELECT user_id, event_id, event_type AS h, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, h AS owner, us + 21600000000 AS held_until, true AS acquired FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN r.held_until < o.us OR r.owner = o.h THEN o.h ELSE r.owner END, CASE WHEN r.held_until < o.us OR r.owner = o.h THEN o.us + 21600000000 ELSE r.held_until END, r.held_until < o.us OR r.owner = o.h FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT event_id, acquired, held_until FROM r"""


@query("q_lock_replay", _REPLAY)
def q_lock_replay(spark, d):
    e = D.table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(c("ts").cast("timestamp")).alias("us"))
    return control.replay_locks(e, "user_id", "event_type", "us", ["us", "event_id"], 21_600_000_000).select("event_id", "acquired", "held_until")


# --- archives, written and read back ------------------------------------------------------------------

_STORED = "(SELECT 'DOC' || doc_id || '_' || strftime(DATE '2024-01-01' + CAST(doc_id % 7 AS INTEGER), '%Y%m%d') || '_x.txt' AS name, doc_id, text FROM documents)"


def _store(spark, d):
    """All documents packed into one archive for each day and shard, in a folder of the shared space."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="larder-store-")
    path = f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"
    rows = D.files(spark, d, payload=True).select(F.concat(lit("DOC"), c("id").cast("string"), lit("_"), F.date_format("day", "yyyyMMdd"), lit("_x.txt")).alias("name"), "day", c("text").cast("binary").alias("data"))
    store.write_store(rows, path, 2)
    return path


@query("q_archive_roundtrip", f"SELECT name, CAST(strlen(text) AS BIGINT) AS data_length, sha256(text) AS digest FROM {_STORED}")
def q_archive_roundtrip(spark, d):
    return store.read_store(spark, _store(spark, d), payload=True).select("name", "data_length", F.sha2("data", 256).alias("digest"))


@query("q_archive_index", f"SELECT name, CAST(strlen(text) AS BIGINT) AS data_length, 0::BIGINT AS flags FROM {_STORED}")
def q_archive_index(spark, d):
    return store.read_store(spark, _store(spark, d)).select("name", "data_length", "flags")


@query("q_archive_point_lookup", f"SELECT name, sha256(text) AS digest FROM {_STORED} WHERE doc_id = 77")
def q_archive_point_lookup(spark, d):
    return store.read_store(spark, _store(spark, d), payload=True, bits="2").where(c("name") == "DOC77_20240101_x.txt").select("name", F.sha2("data", 256).alias("digest"))


@query("q_archive_batch_read", f"SELECT name, sha256(text) AS digest, 200 AS status FROM {_STORED} WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'DOC' || doc_id || '_20231231_x.txt', NULL, 404 FROM labels")
def q_archive_batch_read(spark, d):
    docs = D.table(spark, d, "labels")
    name = lambda day: F.concat(lit("DOC"), c("doc_id").cast("string"), lit("_"), day, lit("_x.txt")).alias("name")
    asked = docs.select(name(F.date_format(F.date_add(lit("2024-01-01").cast("date"), (c("doc_id") % 7).cast("int")), "yyyyMMdd"))).unionByName(docs.select(name(lit("20231231"))))
    return store.lookup(spark, asked, _store(spark, d), 2).select("name", F.sha2("data", 256).alias("digest"), "status")


@query("q_archive_footers", f"SELECT count(*) AS archives, CAST(sum(n) AS BIGINT) AS members, CAST(sum(b) AS BIGINT) AS data_bytes, 0::BIGINT AS faults FROM (SELECT doc_id % 7 AS day, {D.sha_bits('name', 2)} AS s, count(*) AS n, sum(strlen(text)) AS b FROM {_STORED} GROUP BY ALL)")
def q_archive_footers(spark, d):
    f = archive.footers(spark, _store(spark, d))
    return f.agg(F.count(lit(1)).alias("archives"), F.sum("file_count").alias("members"), F.sum("data_length").alias("data_bytes"), F.count_if(c("error").isNotNull()).alias("faults"))
