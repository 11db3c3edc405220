"""The control plane: claims, locks, marks and container records as state-in, state-out transforms.

Every function takes the table as it is and returns the table as it should be (or rows to add to it).
``now`` is always given. Ties are settled by ids, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from .ordering import row_numbers


def claim(files: DataFrame, shard: Column, per_shard: int, holder: Column, now: Column, where: str | None = None, shards: list[int] | None = None, pending: str = "pending", claimed: str = "claimed", id_col: str = "id") -> DataFrame:
    """Claim the first rows by id of each shard. The shard filter comes before the limit, so no shard starves."""
    rows = files.where(F.expr(where)) if where else files
    rows = rows.where(F.col("status") == pending).withColumn("shard_id", shard)
    if shards is not None:
        rows = rows.where(F.col("shard_id").isin(*shards))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("shard_id").orderBy(id_col))).where(F.col("_n") <= per_shard)
    return ranked.drop("_n").withColumns({"status": F.lit(claimed), "claimed_by": holder, "claimed_at": now})


def applied(files: DataFrame, changes: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """Merge: rows named by the changes take their columns, the others stay as they are."""
    new = changes.select(id_col, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = files.join(new, id_col, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in files.columns])


def budget(sources: DataFrame, rank: str, id_col: str, limit: int, fair: bool = False) -> DataFrame:
    """A global limit over several sources: in source order, or by turns (one of each source at a time).

    At most ``limit`` rows of a source can be taken, so each source is cut to that first, in parallel.
    """
    own = sources.withColumn("turn", F.row_number().over(Window.partitionBy(rank).orderBy(id_col))).where(F.col("turn") <= limit)
    order = [F.col("turn"), F.col(rank)] if fair else [F.col(rank), F.col(id_col)]
    return own.orderBy(*order).limit(limit)


def pair_names(ids: Column, names: Column) -> Column:
    """Positions of two arrays paired, to the shorter one's end."""
    n = F.least(F.size(ids), F.size(names))
    return F.slice(F.arrays_zip(ids.alias("id"), names.alias("des_name")), 1, F.greatest(n, F.lit(0)))


def mark_packed(files: DataFrame, packed: DataFrame, now: Column) -> DataFrame:
    """packed: id, des_name, container id."""
    changes = packed.select("id", F.lit("packed").alias("status"), "des_name", "des_container_id", now.alias("packed_at"))
    return applied(files, changes, [c for c in ("status", "des_name", "des_container_id", "packed_at") if c in files.columns])


def mark_failed(files: DataFrame, failed: DataFrame) -> DataFrame:
    """failed: id, error; the message is cut to the column's length."""
    changes = failed.select("id", F.lit("failed").alias("status"), S.truncated(F.col("error")).alias("error_message"))
    return applied(files, changes, [c for c in ("status", "error_message") if c in files.columns])


def acquire(locks: DataFrame, requests: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """One request per shard (shard_id, holder_id) against the locks: the new table, with ``acquired`` for each request.

    A request wins where there is no lock, the lock has expired (``expires_at < now``) or is its own.
    """
    have = locks.select("shard_id", F.col("holder_id").alias("_holder"), F.col("expires_at").alias("_expires"))
    both = have.join(requests.select("shard_id", F.col("holder_id").alias("_asks")), "shard_id", "full_outer")
    asked = F.col("_asks").isNotNull()
    wins = asked & (F.col("_holder").isNull() | (F.col("_expires") < now) | (F.col("_holder") == F.col("_asks")))
    return both.select("shard_id", F.when(wins, F.col("_asks")).otherwise(F.col("_holder")).alias("holder_id"), F.when(wins, now + F.expr(f"INTERVAL {ttl_seconds} SECONDS")).otherwise(F.col("_expires")).alias("expires_at"), F.when(asked, F.coalesce(wins, F.lit(False))).alias("acquired"))


def renew(locks: DataFrame, holders: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Extend locks that the asking holder owns and that have not expired (``expires_at > now``); others are reported lost."""
    j = locks.join(holders.select("shard_id", F.col("holder_id").alias("_asks")), "shard_id", "left")
    ok = F.coalesce((F.col("_asks") == F.col("holder_id")) & (F.col("expires_at") > now), F.lit(False))
    return j.select("shard_id", "holder_id", F.when(ok, now + F.expr(f"INTERVAL {ttl_seconds} SECONDS")).otherwise(F.col("expires_at")).alias("expires_at"), ok.alias("renewed"), (F.col("_asks").isNotNull() & ~ok).alias("lost"))


def release(locks: DataFrame, holders: DataFrame) -> DataFrame:
    """Locks that no releasing holder owns."""
    return locks.join(holders.select("shard_id", "holder_id"), ["shard_id", "holder_id"], "left_anti")


def release_expired(locks: DataFrame, now: Column) -> DataFrame:
    return locks.where(~F.coalesce(P.expired_lock(F.col("expires_at"), now), F.lit(False)))


def insert_containers(containers: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Records for (shard_id, day, s3_key) in state ``writing``, numbered after the largest id by day, shard and key; each day is numbered by itself."""
    top = containers.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rows = row_numbers(new, ["day", "shard_id", "s3_key"], F.col("day"), "_n").join(F.broadcast(top))
    return rows.select((F.col("_top") + F.col("_n")).cast("long").alias("id"), "shard_id", "day", F.lit("writing").alias("status"), "s3_key", F.lit(0).cast("long").alias("file_count"), F.lit(0).cast("long").alias("data_bytes"), now.alias("created_at"))


def progress(containers: DataFrame, reached: DataFrame) -> DataFrame:
    """Container records with what their last checkpoint tells (reached: id, file_count, data_bytes, a row a checkpoint); finished containers stay as they are."""
    last = reached.groupBy("id").agg(F.max_by(F.struct("file_count", "data_bytes"), "file_count").alias("_x")).select("id", "_x.file_count", "_x.data_bytes")
    return update_containers(containers, last.join(containers.where("status = 'writing'").select("id"), "id", "left_semi"))


def update_containers(containers: DataFrame, changes: DataFrame) -> DataFrame:
    """Columns that a change gives (not null) replace those of the record with its id."""
    cols = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *[F.col(c).alias(f"_new_{c}") for c in cols])
    return containers.join(new, "id", "left").select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in containers.columns])


def finalise(containers: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Uploaded containers: state and time."""
    return update_containers(containers, done.select("id", F.lit("uploaded").alias("status"), now.alias("finalized_at")))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by partial aggregation."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*key, "_x.*")


def checkpoints(events: DataFrame, key: list[str], order: list[str], every: int) -> DataFrame:
    """The count rule: every N-th row of a container writes a checkpoint."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return events.withColumn("file_count", n).withColumn("checkpoint", F.pmod(F.col("file_count"), F.lit(every)) == 0)


def checkpoints_timed(events: DataFrame, key: str, order: list[str], ts: str, every: int, interval: int) -> DataFrame:
    """Both rules: every N-th row of a container, or ``interval`` since its last checkpoint (at first, its first row), writes one (ts and interval in one integer unit)."""
    from .cachesim import replay

    def decide(state, cols, i):
        t = cols[ts][i]
        state["n"] = state.get("n", 0) + 1
        due = state["n"] % every == 0 or t - state.setdefault("last", t) >= interval
        if due:
            state["last"] = t
        return due

    return replay(events, key, order, key, decide, (ts,)).withColumnRenamed("hit", "checkpoint")


def rollovers(events: DataFrame, key: list[str], order: list[str], day: str) -> DataFrame:
    """Rows at which the day changes, so that the container before them is finalised."""
    before = F.lag(day).over(Window.partitionBy(*key).orderBy(*order))
    return events.withColumn("closes_day", before).where(F.col("closes_day") != F.col(day))


def replay_locks(requests: DataFrame, shard: str, holder: str, ts: str, order: list[str], ttl: int) -> DataFrame:
    """Lock requests replayed shard by shard in order (ts and ttl in one integer unit): whether each acquires, and until when the shard is held after it. Streams over sorted rows, one lock at a time."""
    import pyarrow as pa

    seen = list(dict.fromkeys([shard, holder, ts, *order]))

    def run(batches):
        current, owner, until = object(), None, None
        for batch in batches:
            won, held = [], []
            for s, h, t in zip(*[batch.column(c).to_pylist() for c in (shard, holder, ts)], strict=True):
                if s != current:
                    current, owner, until = s, None, None
                ok = owner is None or until < t or owner == h
                if ok:
                    owner, until = h, t + ttl
                won.append(ok)
                held.append(until)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in seen], pa.array(won), pa.array(held, pa.int64())], [*seen, "acquired", "held_until"])

    kinds = ", ".join(f"{c} {requests.schema[c].dataType.simpleString()}" for c in seen)
    return requests.select(*seen).repartition(F.col(shard)).sortWithinPartitions(shard, *order).mapInArrow(run, f"{kinds}, acquired boolean, held_until long")
