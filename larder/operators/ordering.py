"""Numbers along an order without one task that sees all rows.

Rows are cut into buckets that do not decrease along the order. Each bucket is numbered by itself; a
table with one row a bucket carries what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_key(left: str, right: str, columns: list[str]) -> Column:
    """All columns equal, nulls too, between the sides of a join with these aliases."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def row_numbers(rows: DataFrame, order: list[str], bucket: Column, name: str, key: list[str] | None = None) -> DataFrame:
    """``name``: numbers from one along the order, within each key (without one, over all rows)."""
    by = [*(key or []), "_bucket"]
    own = rows.withColumn("_bucket", bucket).withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    counts = own.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.partitionBy(*(key or [])).orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    out = own.alias("r").join(before.alias("b"), same_key("r", "b", by), "left")
    return out.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col(f"r.{name}") + F.col("b._before")).cast("long").alias(name))


def paced_slots(rows: DataFrame, ms: Column, order: list[str], per: int, name: str, key: list[str] | None = None, span_bits: int = 16) -> DataFrame:
    """``name``: the first free of ``per`` slots a millisecond at or after each row's, in order of time, then ``order``, within each key.

    In closed form: slot_k = k + max(per * ms_j - k_j) over the rows j up to k. Buckets are spans of 2^span_bits ms.
    """
    by = [*(key or []), "_bucket"]
    w = Window.partitionBy(*by).orderBy(F.col("_ms").asc_nulls_first(), *order)
    own = rows.withColumn("_ms", ms).withColumn("_bucket", F.shiftright(F.col("_ms"), span_bits)).withColumn("_k", F.row_number().over(w).cast("long"))
    own = own.withColumn("_lead", F.max(per * F.col("_ms") - F.col("_k")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = own.groupBy(*by).agg(F.max("_k").alias("_rows"), F.max("_lead").alias("_most"))
    along = Window.partitionBy(*(key or [])).orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_rows").over(along), F.lit(0)))
    sums = sums.withColumn("_ahead", F.max(F.col("_most") - F.col("_before")).over(along)).drop("_rows", "_most")
    out = own.alias("r").join(sums.alias("b"), same_key("r", "b", by), "left")
    lead = F.greatest(F.col("r._lead") - F.col("b._before"), F.col("b._ahead"))
    return out.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("r._k") + F.col("b._before") + lead).alias(name))
