"""The daily sharded store: names, shards and days decide where a member goes and where it is found."""

from __future__ import annotations

import json
from functools import partial
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions import scalars as S
from . import retry
from .archive import INDEX_DDL, ArchiveReader, batches_of, containers_under, directories, file_system, prepare, register
from .codec import EXTERNAL


def write_store(rows: DataFrame, path: str, bits: int, hexadecimal: bool = False, **options: str) -> None:
    """Write (name, day, data[, meta, force_external]) rows: one archive per day and shard, ``day/shard_NN`` or ``day/hex``."""
    register(rows.sparkSession)
    shard = S.shard_id(F.col("name"), bits)
    label = S.shard_hex(shard, bits) if hexadecimal else F.concat(F.lit("shard_"), F.format_string("%02d", shard))
    keep = [c for c in ("meta", "force_external") if c in rows.columns]
    own = rows.select(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("/"), label).alias("container"), "name", "data", *keep)
    prepare(own).write.format("archive").mode("append").options(**options).save(path)


def read_store(spark: SparkSession, path: str, payload: bool = False, **options: str) -> DataFrame:
    """Members of all archives; a filter on name goes into the reader."""
    register(spark)
    return spark.read.format("archive").options(payload=str(payload).lower(), **options).load(path)


def day_archives(path: str, day: str) -> list[str]:
    return [p for p, _ in containers_under(path, day)]


def lookup(spark: SparkSession, names: DataFrame, path: str, bits: int, payload: bool = True, spread: int = 4, gap: int = 1 << 20) -> DataFrame:
    """Named members with a status: 400 without a day in the name, 404 where nothing is found, 200.

    The day and shard of a name say which archive it is in. Names are dealt by archive (an archive's
    to ``spread`` tasks, so that a hot one is not one task's) and sorted; a task opens the archives of its
    names alone, and of these reads the directory and, with ``payload``, the merged ranges of the
    members asked for. Of a member that several stream batches hold, the newest is taken.
    """
    out = f"name string, day date, shard_id long, {INDEX_DDL.replace('container string, ', '').replace('name string, ', '')}" + (", meta string, data binary" if payload else "")
    fields = [f.split(" ")[0] for f in out.split(", ")]
    kinds = {"name": pa.string(), "day": pa.date32(), "ordinal": pa.int32(), "meta": pa.string(), "data": pa.binary()}

    def run(batches):
        fs, root = file_system(path)
        folders = batches_of(fs, root)
        reader = ArchiveReader({"path": path, "payload": str(payload), "maxGap": gap})
        seen: tuple[str, list] = ("", [])

        def archives(home: str) -> list:
            infos = fs.get_file_info([f"{folder}/{home}" for folder in folders])
            return [(i.path, i.size) for i in infos if i.type == pafs.FileType.File]

        for part in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
            rows = [dict.fromkeys(fields) | r for r in part.to_pylist()]
            for home, group in groupby(rows, lambda r: r["home"]):
                if home is None:
                    continue
                if seen[0] != home:
                    seen = (home, archives(home))
                missing = {}
                for r in group:
                    missing.setdefault(r["name"], []).append(r)
                for archive_path, size in seen[1]:
                    if not missing:
                        break
                    with fs.open_input_file(archive_path) as f:
                        last = {e.name: (i, e) for i, e in enumerate(directories.get(f, archive_path, size)[1])}
                        own = [last[n] for n in missing if n in last]
                        for got in reader.batch(f, archive_path, own).to_pylist() if own else ():
                            for r in missing.pop(got["name"]):
                                r |= {k: v for k, v in got.items() if k != "container"}
            yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], kinds.get(f, pa.int64())) for f in fields], fields)

    located = names.select("name", S.parse_day(F.col("name")).alias("day"), S.shard_id(F.col("name"), bits).cast("long").alias("shard_id"))
    home = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("/shard_"), F.format_string("%02d", F.col("shard_id")), F.lit(".des"))
    dealt = located.withColumn("home", home).repartition(F.col("home"), F.pmod(F.xxhash64("name"), F.lit(spread))).sortWithinPartitions("home", "name")
    return dealt.mapInArrow(run, out).withColumn("status", F.when(F.col("day").isNull(), 400).when(F.col("data_length").isNull(), 404).otherwise(200))


def from_folder(spark: SparkSession, folder: str, day: Column) -> DataFrame:
    """Files of a buffer folder as members to store: name, day, data."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(S.basename(F.col("path")).alias("name"), day.alias("day"), F.col("content").alias("data"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Objects under a folder: key, size and time, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("key"), F.col("length").alias("size"), "modificationTime")


def _read(fs: pafs.FileSystem, path: str) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read()


def with_objects(rows: DataFrame, spark: SparkSession, folder: str, key: str = "s3_key") -> DataFrame:
    """Rows with the bytes (``data``) of the objects their keys name; rows without an object are left out. Only those objects are opened, in tasks."""
    names = rows.columns

    def run(batches):
        fs, root = file_system(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, data, keep = batch.slice(at, 64), [], []
                for k in part.column(key).to_pylist():
                    try:
                        data.append(retry.call(partial(_read, fs, f"{root}/{k}")))
                        keep.append(True)
                    except (FileNotFoundError, IsADirectoryError):
                        data.append(None)
                        keep.append(False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], [*names, "data"]).filter(pa.array(keep))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("data", BinaryType())]))


def clear(path: str) -> None:
    """Remove a store's folder, if there is one."""
    fs, root = file_system(path)
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        fs.delete_dir(root)


def with_external(members: DataFrame, folder: str) -> DataFrame:
    """Members with the bytes of external ones filled in from the keys in their metadata (or, without one, from ``_bigFiles``); external members whose object is gone are left out. Only their objects are opened, in tasks."""
    names = members.columns

    def run(batches):
        fs, root = file_system(folder)
        for batch in batches:
            data, keep = batch.column("data").to_pylist(), [True] * batch.num_rows
            for i, (flags, meta, name) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("flags", "meta", "name")], strict=True)):
                if flags & EXTERNAL:
                    key = json.loads(meta or "{}").get("external_key", f"_bigFiles/{name}")
                    try:
                        with fs.open_input_file(f"{root}/{key}") as f:
                            data[i] = f.read()
                    except FileNotFoundError:
                        keep[i] = False
            out = pa.RecordBatch.from_arrays([pa.array(data, pa.binary()) if c == "data" else batch.column(c) for c in names], names)
            yield out.filter(pa.array(keep))

    return members.mapInArrow(run, members.schema)
