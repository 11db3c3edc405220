"""Read-path routing: primary and fallback endpoints, circuit breaker, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ordering import paced_slots, row_numbers


def healthy_now(endpoints: DataFrame, now: Column, timeout_seconds: int = 30) -> DataFrame:
    """Endpoints with ``healthy``: marked so, or their last failure is longer ago than the timeout."""
    ago = F.col("last_failure_time") < now - F.expr(f"INTERVAL {timeout_seconds} SECONDS")
    return endpoints.withColumn("healthy", F.col("is_healthy") | F.coalesce(ago, F.lit(False)))


def route(requests: DataFrame, endpoints: DataFrame, byte: Column) -> DataFrame:
    """Primary by byte modulo the number of endpoints, or else the first healthy one, or else the primary; and the ordered fallbacks.

    endpoints (place, id, healthy) is a service's configuration, some dozens of rows; it travels as one array.
    """
    table = endpoints.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "healthy"))), lambda e: F.struct(e["id"].alias("id"), e["healthy"].alias("healthy"))).alias("_e"))
    j = requests.withColumn("hash_byte", byte).join(F.broadcast(table))
    e = F.col("_e")
    primary = F.get(e, F.pmod(F.col("hash_byte"), F.size(e)).cast("int"))
    up = F.filter(e, lambda x: x["healthy"])
    chosen = F.when(primary["healthy"], primary["id"]).otherwise(F.coalesce(F.get(up, 0)["id"], primary["id"]))
    out = j.withColumns({"primary_id": primary["id"], "target_id": chosen, "_up": up})
    return out.withColumn("fallback_ids", F.transform(F.filter("_up", lambda x: x["id"] != F.col("target_id")), lambda x: x["id"])).drop("_e", "_up")


def round_robin(requests: DataFrame, order: list[str], healthy: int, key: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """Turn of each request: among its key's (a router's) requests, or among all in one order, numbered by buckets that do not decrease along it."""
    if key:
        return requests.withColumn("turn", F.pmod(F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1, F.lit(healthy)))
    if bucket is None:
        raise ValueError("one order over all requests needs a bucket that follows it")
    return row_numbers(requests, order, bucket, "turn").withColumn("turn", F.pmod(F.col("turn") - 1, F.lit(healthy)))


def failure_runs(calls: DataFrame, key: list[str], order: list[str], failed: Column) -> DataFrame:
    """Runs of consecutive failures by endpoint: their start and length."""
    w = Window.partitionBy(*key).orderBy(*order)
    numbered = calls.withColumns({"_failed": failed.cast("int")}).withColumn("_island", F.sum(1 - F.col("_failed")).over(w))
    return numbered.where("_failed = 1").groupBy(*key, "_island").agg(F.count(F.lit(1)).alias("run_length"), *[F.min(c).alias(f"first_{c}") for c in order]).drop("_island")


def breaker_states(calls: DataFrame, key: str, order: list[str], ts: str, failed: str, threshold: int, timeout_us: int) -> DataFrame:
    """The timed breaker replayed for each endpoint in order: whether the call found it open, and its count after. Streams over sorted rows of a partition, one state at a time."""
    import pyarrow as pa

    names = [key, *order, ts, failed]
    seen = list(dict.fromkeys(names))

    def run(batches):
        current, count, opened = object(), 0, None
        for batch in batches:
            k, t, f = (batch.column(c).to_pylist() for c in (key, ts, failed))
            opens, counts = [], []
            for a, b, c in zip(k, t, f, strict=True):
                if a != current:
                    current, count, opened = a, 0, None
                if opened is not None and b - opened > timeout_us:
                    count, opened = 0, None
                opens.append(opened is not None)
                if c:
                    count += 1
                    last = b
                    if count >= threshold:
                        opened = last
                else:
                    count, opened = 0, None
                counts.append(count)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in seen], pa.array(opens), pa.array(counts, pa.int64())], [*seen, "found_open", "failures"])

    kinds = ", ".join(f"{c} {calls.schema[c].dataType.simpleString()}" for c in seen)
    own = calls.select(*seen).repartition(F.col(key)).sortWithinPartitions(key, *order)
    return own.mapInArrow(run, f"{kinds}, found_open boolean, failures long")


def token_bucket(requests: DataFrame, key: list[str], order: list[str], arrival: str, interval: float, capacity: int) -> DataFrame:
    """When a bucket lets each request go, in closed form: with theoretical times tat_k = kT + max(arrival_j - (j - 1)T), request k leaves at max(arrival, tat_(k-1) - (C - 1)T)."""
    w = Window.partitionBy(*key).orderBy(*order)
    k = F.row_number().over(w)
    d = requests.withColumn("_k", k).withColumn("_slack", F.max(F.col(arrival) - (F.col("_k") - 1) * F.lit(interval)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    before = F.col("_slack") + (F.col("_k") - 1) * F.lit(interval)
    return d.withColumn("release", F.greatest(F.col(arrival), F.coalesce(before - (capacity - 1) * interval, F.col(arrival)))).drop("_k", "_slack")


def locate(requests: DataFrame, prefix: str, bits: int, name: str = "name") -> DataFrame:
    """Day, shard and container key of names; a name without a day is a bad request (status 404)."""
    out = requests.withColumns({"day": S.parse_day(F.col(name)), "shard_id": S.shard_id(F.col(name), bits)})
    return out.withColumns({"container_key": F.when(F.col("day").isNotNull(), S.container_key(prefix, F.col("day"), F.col("shard_id"))), "status": F.when(F.col("day").isNull(), 404).otherwise(200)})


def assign(rows: DataFrame, prefix: str, ts: str, node: int, key: list[str], order: list[str], bits: int, wrap_bits: int = 32) -> DataFrame:
    """Names for rows, no two alike within a key (a generator): each row takes the first of the 256 places of a millisecond that is free at or after its time; with shard and day. A row without a time gets no name."""
    from ..functions.predicates import valid_naming

    valid_naming(prefix, node, wrap_bits)
    out = paced_slots(rows, F.unix_millis(F.col(ts).cast("timestamp")), order, S.PER_MILLISECOND, "_slot", key)
    f = S.f48(F.expr(f"_slot div {S.PER_MILLISECOND}"), node, F.pmod(F.col("_slot"), F.lit(S.PER_MILLISECOND)), wrap_bits)
    out = out.withColumns({"day": F.to_date(ts), "name": S.snowflake_name(prefix, F.to_date(ts), f)})
    return out.withColumn("shard_id", S.shard_id(F.col("name"), bits)).drop("_slot")
