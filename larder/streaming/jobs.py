"""Continuous forms: marking, packing and lock tracking as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..operators import catalog, control
from ..sources.store import clear, write_store


def run_marker(entries: DataFrame, marked_path: str, dead_path: str, checkpoint: str, max_retries: int = 3, error: Callable | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Mark arriving catalog entries; failures for good go to the dead letters, transient ones come out as ``retry``.

    ``error`` gives the error of an entry as a column (null: none). A batch is written under its id,
    so a repeated batch replaces its own output and counts once.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        tried = df.withColumns({"error": error(df) if error else F.lit(None).cast("string"), "retry_count": F.coalesce("retry_count", F.lit(0))})
        settled = catalog.settle(tried, max_retries).withColumn("des_name", F.coalesce("des_name", "source_key"))
        done = settled.withColumns({"des_hash": S.hash_hex(F.col("des_name")), "des_shard": S.marker_shard(F.col("des_name"))})
        done.write.mode("overwrite").parquet(f"{marked_path}/batch={batch_id}")
        dead = catalog.dead_letters(settled.where("des_status = 'failed'"), max_retries, F.col("created_at"))
        dead.write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_packer(rows: DataFrame, store: str, bits: int, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Pack arriving (name, day, data) rows: each batch adds archives of its own beside those of the days before it. A repeated batch replaces what its earlier attempt left."""

    def batch(df: DataFrame, batch_id: int) -> None:
        own = f"{store}/batch-{batch_id:09d}"
        clear(own)
        if not df.isEmpty():
            write_store(df, own, bits)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def track_locks(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """Requests (shard_id, holder_id, ts) answered in time order by keyed state: acquired where the shard is free, expired or the holder's own."""

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        holder, expires = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values(["ts", "holder_id"], kind="stable")
        won = []
        for h, t in zip(rows["holder_id"], rows["ts"], strict=True):
            us = t.value // 1000
            ok = holder is None or expires < us or holder == h
            if ok:
                holder, expires = h, us + ttl_seconds * 1_000_000
            won.append(ok)
        state.update((holder, expires))
        yield pd.DataFrame({"shard_id": key[0], "holder_id": rows["holder_id"], "ts": rows["ts"], "acquired": won})

    return requests.groupBy("shard_id").applyInPandasWithState(decide, "shard_id long, holder_id string, ts timestamp, acquired boolean", "holder_id string, expires long", "append", "NoTimeout")


def run_heartbeat(spark: SparkSession, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], holders: DataFrame, ttl_seconds: int, every: str, checkpoint: str) -> StreamingQuery:
    """Renew the holders' locks on a timer: ``read`` gives the lock table, ``write`` takes it renewed (with ``renewed`` and ``lost``) and the beat's number."""

    def beat(ticks: DataFrame, batch_id: int) -> None:
        now = ticks.agg(F.max("timestamp").cast("timestamp_ntz").alias("now")).first()["now"]
        if now is not None:
            write(control.renew(read(), holders, F.lit(now).cast("timestamp_ntz"), ttl_seconds), batch_id)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(beat).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def daily_counts(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Members per day of event time, closed by a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "n")


def main(argv: list[str] | None = None) -> None:
    """``python -m larder.streaming.jobs CATALOG MARKED DEAD CHECKPOINT``: mark what has arrived and stop."""
    import sys

    source, marked, dead, checkpoint = argv or sys.argv[1:]
    spark = SparkSession.builder.getOrCreate()
    schema = spark.read.parquet(source).schema
    run_marker(spark.readStream.schema(schema).parquet(source), marked, dead, checkpoint).awaitTermination()


if __name__ == "__main__":
    main()
