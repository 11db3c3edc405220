"""Crash recovery: stale claims, partial containers, expired locks, integrity and orphans.

Each returns a plan (what would change); deletes are rows of a plan and are carried out by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S

BIG_FILES = "_bigFiles/"


def release_stale(files: DataFrame, now: Column, timeout_seconds: int = 300) -> tuple[DataFrame, DataFrame]:
    """The table with stale claims pending again, and the rows released."""
    stale = F.coalesce(P.stale_claim(F.col("status"), F.col("claimed_at"), now - F.expr(f"INTERVAL {timeout_seconds} SECONDS")), F.lit(False))
    new = files.withColumn("_stale", stale)
    out = new.select(*[F.when(F.col("_stale"), F.lit("pending")).otherwise(F.col(c)).alias(c) if c == "status" else F.when(~F.col("_stale"), F.col(c)).alias(c) if c in ("claimed_by", "claimed_at") else F.col(c) for c in files.columns])
    return out, files.where(stale)


def settle_partial(containers: DataFrame, objects: DataFrame, now: Column, grace_seconds: int = 900, prefix: str | None = None) -> DataFrame:
    """Containers stuck in writing, and what becomes of them: uploaded if their object is valid, failed if it is missing or not.

    objects: key, valid, file_count.
    """
    stuck = containers.where(P.stuck_container(F.col("status"), F.col("created_at"), now - F.expr(f"INTERVAL {grace_seconds} SECONDS")))
    found = stuck.withColumn("_key", S.full_key(F.col("s3_key"), prefix)).join(objects.select(F.col("key").alias("_key"), "valid", F.col("file_count").alias("actual")), "_key", "left").drop("_key")
    return found.withColumns({"new_status": F.when(F.coalesce(F.col("valid"), F.lit(False)), "uploaded").otherwise("failed"), "reason": F.when(F.col("valid").isNull(), "missing").when(F.col("valid"), "complete").otherwise("invalid")})


def integrity(containers: DataFrame, objects: DataFrame, prefix: str | None = None, compat: bool = False) -> DataFrame:
    """Records whose object is missing, invalid or of another count. Only uploaded ones, unless ``compat``."""
    own = containers if compat else containers.where(F.col("status") == "uploaded")
    j = own.withColumn("_key", S.full_key(F.col("s3_key"), prefix)).join(objects.select(F.col("key").alias("_key"), "valid", F.col("file_count").alias("actual")), "_key", "left").drop("_key")
    issue = F.when(F.col("valid").isNull(), "missing").when(~F.col("valid"), "invalid").when(F.col("actual") != F.col("file_count"), "count_mismatch")
    return j.withColumn("issue", issue).where("issue IS NOT NULL")


def orphans(objects: DataFrame, containers: DataFrame, prefix: str | None = None) -> DataFrame:
    """Listed objects that no container record names; external payloads are never orphans."""
    known = containers.select(S.full_key(F.col("s3_key"), prefix).alias("key")).distinct()
    return objects.where(~F.col("key").contains(BIG_FILES)).join(known, "key", "left_anti")


def deletion_plan(found: DataFrame) -> DataFrame:
    return found.select(F.lit("delete").alias("action"), "key")


def sweep(files: DataFrame, locks: DataFrame, containers: DataFrame, objects: DataFrame, now: Column) -> DataFrame:
    """All recovery actions as one log: (action, key)."""
    _, stale = release_stale(files, now)
    partial, bad = settle_partial(containers, objects, now), integrity(containers, objects)
    parts = [
        stale.select(F.lit("release_claim").alias("action"), F.col("id").cast("string").alias("key")),
        locks.where(P.expired_lock(F.col("expires_at"), now)).select(F.lit("release_lock").alias("action"), F.col("shard_id").cast("string").alias("key")),
        partial.select(F.concat(F.lit("container_"), F.col("new_status")).alias("action"), F.col("id").cast("string").alias("key")),
        bad.select(F.concat(F.lit("integrity_"), F.col("issue")).alias("action"), F.col("id").cast("string").alias("key")),
        deletion_plan(orphans(objects, containers)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
