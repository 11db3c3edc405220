"""What the corpus operators share: the shared folder, written cuts and blob shuffles."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (single-machine tests) a folder of our own is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="larder-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/larder-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._larder_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a written cut that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._larder_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles and broadcasts of finished steps nobody holds any more, so that their files go."""
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Give what a worker has freed back to the system, where its C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def steady(spark: SparkSession) -> None:
    """Unions of differently adapted inputs are to be planned without zipping their partitions, which fails when their numbers differ."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    col = batch.column(column)
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return [b"" if x is None else x for x in col.to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``size`` bytes of text each (one row at least), with their texts."""
    for batch in batches:
        texts = texts_of(batch, column)
        at = got = 0
        for i, t in enumerate(texts):
            got += len(t)
            if got >= size or i == len(texts) - 1:
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, got = i + 1, 0


#: What a null document id counts as where ids are compared; the largest number, so a real id of that value is the same document.
LAST = (1 << 63) - 1


def number(df: DataFrame, column: str):
    """An id column as a long. Ids are compared as numbers, so other types are refused before anything runs."""
    kind = df.select(F.col(column)).schema[0].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"{column} must be an integer column, it is {kind.simpleString()}")
    return F.col(column).cast("long")


def document(df: DataFrame, column: str):
    """A document id as a long, null last."""
    return F.coalesce(number(df, column), F.lit(LAST))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_bucket(df: DataFrame, n: int, column: str = "bucket") -> DataFrame:
    """Deal rows of packed blobs to n partitions by their bucket."""
    return df.repartition(n, F.col(column))


def crc_mod(col, m: int):
    """crc32 of the value as text, modulo m."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(m)


#: Keys of at most this many documents are broadcast (two numbers each); more are met by shuffle.
BROADCAST_ROWS = 300_000


def without(docs: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in the list (a written table). Null keys stay."""
    few = keys.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(keys) if few else keys, on, "left_anti")


def meet(docs: DataFrame, lists: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join what was found for documents (a written table with one more column than the keys) to the documents, inner or left.

    The lists are never broadcast. If they are for few documents, their keys are, so that only those
    documents' texts are shuffled to meet them; else all texts are.
    """
    if lists.count() > BROADCAST_ROWS:
        return docs.join(lists.hint("shuffle_hash"), on, how)
    keys = F.broadcast(lists.select(*on))
    met = docs.join(keys, on, "left_semi").join(lists.hint("shuffle_hash"), on)
    if how == "inner":
        return met
    own = next(f for f in lists.schema if f.name not in on)
    return met.unionByName(docs.join(keys, on, "left_anti").withColumn(own.name, F.lit(None).cast(own.dataType)))
