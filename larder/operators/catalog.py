"""Catalog marking: candidates, names, retries and dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S

#: A hash strategy: column in, hex digest out. Give any expression, or a pandas UDF where none will do.
HashStrategy = Callable[[Column], Column]


def candidates(catalog: DataFrame, cutoff: Column, batch: int, legacy: bool = False, exclude_failed: bool = False) -> DataFrame:
    """The oldest ids to mark: a top-k, not a sort of everything."""
    c = F.col
    want = P.mark_candidate_legacy(c("created_at"), c("des_status"), c("des_name"), c("des_hash"), c("des_shard"), cutoff) if legacy else P.mark_candidate(c("created_at"), c("des_status"), c("des_name"), cutoff, exclude_failed)
    return catalog.where(want).orderBy("id").limit(batch)


def mark(rows: DataFrame, name: Column, strategy: HashStrategy = S.hash_hex, legacy_bits: int | None = None) -> DataFrame:
    """Name, hash, shard and state of selected rows. The legacy form keeps values that are there and sets its own state."""
    digest = strategy(name)
    if legacy_bits is not None:
        return rows.withColumns({"des_hash": F.coalesce("des_hash", digest), "des_shard": F.coalesce("des_shard", S.shard_id(name, legacy_bits).cast("int")), "des_status": F.lit("DES_TODO"), "des_name": F.coalesce("des_name", name)})
    return rows.withColumns({"des_hash": digest, "des_shard": F.conv(F.substring(digest, 1, 2), 16, 10).cast("int"), "des_status": F.lit("marked"), "des_name": name, "last_error": F.lit(None).cast("string")})


def settle(attempts: DataFrame, max_retries: int) -> DataFrame:
    """Outcome of attempts (error null: done): marked, retry while the error is transient and attempts are left, else failed; with the wait before the next one."""
    error = F.col("error")
    again = error.isNotNull() & P.retryable(error) & (F.col("retry_count") + 1 < max_retries)
    return attempts.withColumns({"des_status": F.when(error.isNull(), "marked").when(again, "retry").otherwise("failed"), "retry_count": F.when(error.isNull(), F.col("retry_count")).otherwise(F.col("retry_count") + 1), "last_error": S.truncated(error), "wait_seconds": F.when(again, F.pow(F.lit(2.0), F.col("retry_count")))})


def dead_letters(failed: DataFrame, max_retries: int, now: Column) -> DataFrame:
    """Dead-letter rows of entries that failed for good."""
    return failed.select(F.col("id").alias("catalog_entry_id"), now.alias("created_at"), S.truncated(F.col("error")).alias("error_message"), F.lit(max_retries).alias("retry_count"), F.lit(False).alias("resolved"))


def requeue(catalog: DataFrame, letters: DataFrame) -> DataFrame:
    """Entries with an unresolved dead letter go back to ``retry`` with their count at zero."""
    ids = letters.where(P.unresolved(F.col("resolved"))).select(F.col("catalog_entry_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    j = catalog.join(ids, "id", "left")
    return j.select(*[F.when(F.col("_hit"), F.lit("retry")).otherwise(F.col(c)).alias(c) if c == "des_status" else F.when(F.col("_hit"), F.lit(0)).otherwise(F.col(c)).alias(c) if c == "retry_count" else F.col(c) for c in catalog.columns])
