"""Operational statistics: counters, histograms, quantiles, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the histograms.
BATCH_SECONDS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0)
ENTRY_MILLISECONDS = (1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 1000.0)


def histogram(values: DataFrame, value: str, bounds: tuple[float, ...], key: list[str] | None = None) -> DataFrame:
    """Cumulative buckets in one pass: all counts are aggregates of one partial aggregation, laid out as rows at the end."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    one = values.groupBy(*(key or [])).agg(*counts, F.count(value).alias("_all"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("count")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("count")))
    return one.select(*(key or []), F.explode(rows).alias("_r")).select(*(key or []), "_r.*")


def quantile(buckets: DataFrame, q: float, key: list[str] | None = None) -> DataFrame:
    """Quantile from cumulative buckets, linear within the bucket it falls into."""
    own = buckets.groupBy(*(key or [])).agg(F.array_sort(F.collect_list(F.struct("le", "count"))).alias("_b"))
    b, rank = F.col("_b"), F.lit(q) * F.element_at("_b", -1)["count"]
    own = own.withColumn("_i", F.size(F.filter(b, lambda x: x["count"] < rank)))
    low = F.when(F.col("_i") > 0, F.get(b, F.col("_i") - 1)["le"]).otherwise(F.lit(0.0))
    below = F.when(F.col("_i") > 0, F.get(b, F.col("_i") - 1)["count"]).otherwise(F.lit(0))
    at = F.get(b, F.col("_i"))
    value = F.when(at["le"] == float("inf"), low).otherwise(low + (at["le"] - low) * (rank - below) / (at["count"] - below))
    return own.select(*(key or []), value.alias("quantile"))


def counters(rows: DataFrame, label: list[str], **sums: str) -> DataFrame:
    return rows.groupBy(*label).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(a) for a, c in sums.items()])


def rates(rows: DataFrame, ts: str, window: str, label: list[str], seconds: float) -> DataFrame:
    """Events per second over tumbling windows."""
    return rows.groupBy(F.window(ts, window).alias("_w"), *label).agg((F.count(F.lit(1)) / F.lit(seconds)).alias("rate")).select(F.col("_w.start").alias("window_start"), *label, "rate")


def batch_stats(attempts: DataFrame, key: list[str], value: str, error: str) -> DataFrame:
    """Attempts, successes, failures, latency and the failures by error as a map. The map is built from counts, so no group of rows is collected."""
    parts = attempts.groupBy(*key, error).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"), F.sum(value).alias("_sum"))
    failed = F.col(error).isNotNull()
    return parts.groupBy(*key).agg(
        F.sum("_n").alias("attempts"), F.coalesce(F.sum(F.when(~failed, F.col("_n"))), F.lit(0)).alias("succeeded"), F.coalesce(F.sum(F.when(failed, F.col("_n"))), F.lit(0)).alias("failed"),
        F.min("_min").alias("min_latency"), F.max("_max").alias("max_latency"), (F.sum("_sum") / F.sum("_n")).alias("avg_latency"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(failed, F.struct(F.col(error), F.col("_n")))))).alias("error_breakdown"),
    )


def lock_health(locks: DataFrame, now: Column) -> DataFrame:
    return locks.agg(F.count_if(F.col("expires_at") > now).alias("held"), F.count_if(F.col("expires_at") <= now).alias("expired"))


def overall_health(critical_ok: Column, locks_ok: Column, expired: Column, sources_ok: Column, connected: Column, enabled: Column) -> Column:
    return F.when(~critical_ok, "unhealthy").when(~locks_ok | (expired > 0) | ~sources_ok | (connected < enabled), "degraded").otherwise("healthy")


def source_health(probes: DataFrame) -> DataFrame:
    """Summary of probes (source, enabled, status): enabled, connected and the failures by source."""
    bad = F.col("enabled") & (F.col("status") != "ok")
    return probes.agg(F.count_if("enabled").alias("enabled"), F.count_if(F.col("enabled") & (F.col("status") == "ok")).alias("connected"), F.map_from_entries(F.array_sort(F.collect_list(F.when(bad, F.struct("source", "status"))))).alias("failures"))


def endpoint_snapshot(endpoints: DataFrame) -> DataFrame:
    return endpoints.select("id", "healthy")


def cache_stats(entries: DataFrame, now: Column) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("expiry") < now).alias("expired"), F.count_if(~(F.col("expiry") < now) | F.col("expiry").isNull()).alias("active"))


def errors_by_message(letters: DataFrame) -> DataFrame:
    return letters.groupBy("error_message").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error_message")


def observed(df: DataFrame, name: str, size: str):
    """The frame with run-time counters attached, and the handle they can be read from."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes")), seen
