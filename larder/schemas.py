"""Relations of the archive domain as Spark schemas."""

from __future__ import annotations

from pyspark.sql.types import StructType

INDEX = StructType.fromDDL("name string, data_offset long, data_length long, meta_offset long, meta_length long, flags long")
FOOTER = StructType.fromDDL("magic string, version int, data_start long, data_length long, meta_start long, meta_length long, index_start long, index_length long, file_count long")
MEMBER = StructType.fromDDL("name string, data binary, meta string")
SHARD_LOCKS = StructType.fromDDL("shard_id int, holder_id string, acquired_at timestamp, heartbeat_at timestamp, expires_at timestamp, state string")
CONTAINERS = StructType.fromDDL("id int, shard_id int, day date, status string, s3_key string, file_count int, data_bytes long, created_at timestamp, finalized_at timestamp")
CATALOG = StructType.fromDDL("id int, created_at timestamp, des_name string, des_hash string, des_shard int, des_status string, retry_count int, last_error string, source_bucket string, source_key string")
DEAD_LETTERS = StructType.fromDDL("id int, catalog_entry_id int, created_at timestamp, error_message string, retry_count int, resolved boolean, resolved_at timestamp")
SOURCE_FILE = StructType.fromDDL("id long, s3_bucket string, s3_key string, size_bytes long, shard_id int, metadata map<string,string>")
PENDING_FILE = StructType.fromDDL("id long, shard_id int, name string, data binary, meta string")
ENDPOINTS = StructType.fromDDL("id string, url string, is_healthy boolean, failure_count int, last_failure_time timestamp")
TABLES = {"des_shard_locks": SHARD_LOCKS, "des_containers": CONTAINERS, "des_source_catalog": CATALOG, "des_marker_dlq": DEAD_LETTERS}


def create_tables(spark, database: str = "default", provider: str = "parquet") -> None:
    """Create the control-plane tables where they do not exist yet."""
    for name, schema in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}) USING {provider}")
