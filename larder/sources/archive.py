"""Archives as a Spark data source: index and payload reads with name pushdown, and a sink with a commit protocol.

    register(spark)
    spark.read.format("archive").option("payload", "false").load(folder)
    rows.write.format("archive").mode("append").save(folder)

Files are reached through pyarrow's file systems, so a path may be local or in any store it knows. The
index is read alone unless ``payload`` is true; then only the ranges that the wanted members need are
read, neighbours merged across gaps of up to ``maxGap`` bytes.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from . import codec, retry

INDEX_DDL = "container string, ordinal int, name string, data_offset long, data_length long, meta_offset long, meta_length long, flags long"
_TYPES = [("container", pa.string()), ("ordinal", pa.int32()), ("name", pa.string()), ("data_offset", pa.int64()), ("data_length", pa.int64()), ("meta_offset", pa.int64()), ("meta_length", pa.int64()), ("flags", pa.int64())]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(path)
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def containers_under(path: str, day: str | None = None) -> list[tuple[str, int]]:
    """Archives in a folder and its day folders (or one archive), with their sizes."""
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(at, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if day is None:
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    else:  # only the day's folders are listed: the store's and those of its stream batches
        folders = [f"{folder}/{day}" for folder in batches_of(fs, at)]
        found = [f for folder in folders for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=True))]
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(".des") and "/." not in f.path[len(at) :])


def batches_of(fs: pafs.FileSystem, root: str) -> list[str]:
    """The folders that may hold a day's folders: those of stream batches, newest first, and the store itself."""
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return [*sorted((f.path for f in found if f.type == pafs.FileType.Directory and f.base_name.startswith("batch-")), reverse=True), root]


def read_directory(f, size: int) -> tuple[codec.Footer, list[codec.Entry]]:
    """Footer and index by three reads: header, footer, index."""
    if size < codec.MIN_SIZE:
        raise codec.ArchiveError("file too small")
    codec.check_header(f.read_at(codec.HEADER.size, 0))
    footer = codec.parse_footer(f.read_at(codec.FOOTER.size, size - codec.FOOTER.size), size)
    return footer, list(codec.parse_index(f.read_at(footer.index_length, footer.index_start), footer.file_count))


def home_of(name: str, bits: int) -> str | None:
    """Where a daily store keeps a member: ``day/shard_NN.des``; None without a day in the name."""
    m = re.search("_([0-9]{8})_", name)
    try:
        day = datetime.strptime(m[1], "%Y%m%d").date() if m else None
    except ValueError:
        day = None
    return f"{day}/shard_{int.from_bytes(hashlib.sha256(name.encode()).digest(), 'big') >> (256 - bits):02d}.des" if day else None


class Directories:
    """Directories of archives that this process has read, by path and size (an archive is never changed), within a number of entries; the least recently used go first."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.kept, self.entries, self.hits, self.misses = limit, OrderedDict(), 0, 0, 0

    def get(self, f, path: str, size: int) -> tuple[codec.Footer, list[codec.Entry]]:
        have = self.kept.pop((path, size), None)
        if have is None:
            self.misses += 1
            have = read_directory(f, size)
            self.entries += len(have[1])
        else:
            self.hits += 1
        self.kept[path, size] = have
        while self.entries > self.limit and len(self.kept) > 1:
            self.entries -= len(self.kept.popitem(last=False)[1][1])
        return have


directories = Directories()


@dataclass
class Container(InputPartition):
    path: str
    size: int

    def __init__(self, path: str, size: int):
        super().__init__((path, size))
        self.path, self.size = path, size


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "false").lower() == "true"
        self.meta = options.get("meta", "false").lower() == "true" or self.payload
        self.gap = int(options.get("maxgap", options.get("maxGap", 1 << 20)))
        self.all = options.get("duplicates", "false").lower() == "true"
        self.broken = options.get("mode", "FAILFAST").upper()
        self.day = options.get("day")
        self.bits = int(options["bits"]) if "bits" in options else None
        self.names: set[str] | None = None

    def pushFilters(self, filters):  # noqa: N802  the API's name
        """Names asked for are looked up in the index before anything else is read."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.names = {f.value} if self.names is None else self.names & {f.value}
            elif isinstance(f, In) and f.attribute == ("name",):
                self.names = set(f.value) if self.names is None else self.names & set(f.value)
            else:
                yield f

    def partitions(self):
        """The archives that can hold what is asked for: with ``bits`` (of a daily store), names tell their day and shard."""
        found = containers_under(self.path, self.day)
        if self.bits is not None and self.names is not None:
            wanted = {at for at in (home_of(n, self.bits) for n in self.names) if at}
            found = [(p, s) for p, s in found if "/".join(p.split("/")[-2:]) in wanted]
        return [Container(p, s) for p, s in found]

    def read(self, part: Container) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        with fs.open_input_file(part.path) as f:
            try:
                _, entries = directories.get(f, part.path, part.size)
            except codec.ArchiveError:
                if self.broken == "DROPMALFORMED":
                    return
                raise
            rows = list(enumerate(entries))
            if not self.all:
                last = {e.name: i for i, e in rows}
                rows = [(i, e) for i, e in rows if last[e.name] == i]
            if self.names is not None:
                rows = [(i, e) for i, e in rows if e.name in self.names]
            for at in range(0, max(len(rows), 1), 1024):
                own = rows[at : at + 1024]
                if own:
                    yield self.batch(f, part.path, own)

    def batch(self, f, path: str, rows: list[tuple[int, codec.Entry]]) -> pa.RecordBatch:
        cols = [[path] * len(rows), [i for i, _ in rows], *[[getattr(e, c) for _, e in rows] for c, _ in _TYPES[2:]]]
        arrays, names = [pa.array(x, t) for x, (_, t) in zip(cols, _TYPES, strict=True)], [c for c, _ in _TYPES]
        if self.meta:
            arrays.append(pa.array([x.decode() for x in self.fetch(f, [(e.meta_offset, e.meta_length) for _, e in rows])], pa.string()))
            names.append("meta")
        if self.payload:
            inside = iter(self.fetch(f, [(e.data_offset, e.data_length) for _, e in rows if not e.external]))
            arrays.append(pa.array([None if e.external else next(inside) for _, e in rows], pa.binary()))
            names.append("data")
        return pa.RecordBatch.from_arrays(arrays, names)

    def fetch(self, f, spans: list[tuple[int, int]]) -> list[bytes]:
        """Bytes of spans in the order given, read in merged ranges one after the other."""
        out: list[bytes] = [b""] * len(spans)
        order = sorted((i for i in range(len(spans)) if spans[i][1]), key=lambda i: spans[i])
        at = 0
        for start, end in codec.merged_ranges(spans, self.gap):
            buffer = f.read_at(end - start, start)
            if len(buffer) < end - start:
                raise codec.ArchiveError("data truncated")
            while at < len(order) and spans[order[at]][0] < end:
                o, n = spans[order[at]]
                out[order[at]] = buffer[o - start : o - start + n]
                at += 1
        return out


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class ArchiveWriter(DataSourceWriter):
    """Each task writes its containers under temporary names; the commit renames them, an abort removes them.

    Rows: container (a path under the folder, without ending), name, data, and optionally meta (JSON
    text) and force_external. Rows of one container must come together in one task: deal and sort
    them with ``prepare``.
    """

    def __init__(self, options: dict, schema):
        self.path, self.schema = options["path"], schema
        self.prefix = options.get("externalprefix", options.get("externalPrefix"))
        self.big_file = int(options.get("bigfile", options.get("bigFile", codec.BIG_FILE)))

    def write(self, rows) -> Written:
        import json

        fs, root = file_system(self.path)
        moves, current, writer, stream = [], None, None, None
        tag = uuid.uuid4().hex
        known = set()
        try:
            for r in rows:
                if r.container != current:
                    if writer:
                        writer.finish()
                        stream.close()
                    current = r.container
                    if current in known:
                        raise codec.ArchiveError(f"rows of {current} do not come together")
                    known.add(current)
                    final, part = f"{root}/{current}.des", f"{root}/.{tag}/{current}.part"
                    if fs.get_file_info(final).type != pafs.FileType.NotFound:
                        raise FileExistsError(final)
                    fs.create_dir(os.path.dirname(part), recursive=True)
                    stream = fs.open_output_stream(part)
                    writer = codec.Writer(stream, self.prefix, self.big_file)
                    moves.append((part, final))
                data = bytes(r.data) if r.data is not None else b""
                fields = r.asDict()
                key = writer.add(r.name, data, json.loads(fields.get("meta") or "{}"), bool(fields.get("force_external")))
                if key:
                    # Whole under its key at once: a repeated attempt stores the same bytes again.
                    fs.create_dir(os.path.dirname(f"{root}/{key}"), recursive=True)
                    with fs.open_output_stream(f"{root}/{key}") as big:
                        big.write(data)
            if writer:
                writer.finish()
                stream.close()
        except BaseException:
            if stream and not stream.closed:
                stream.close()
            fs.delete_dir(f"{root}/.{tag}") if fs.get_file_info(f"{root}/.{tag}").type == pafs.FileType.Directory else None
            raise
        return Written(moves)

    def commit(self, messages) -> None:
        fs, root = file_system(self.path)
        temporary = set()
        for m in messages:
            for part, final in m.moves if m else ():
                retry.call(partial(_move, fs, part, final))
                temporary.add(root + "/" + part[len(root) + 1 :].split("/")[0])
        for t in temporary:
            fs.delete_dir(t)

    def abort(self, messages) -> None:
        fs, root = file_system(self.path)
        for t in {root + "/" + part[len(root) + 1 :].split("/")[0] for m in messages if m for part, _ in m.moves}:
            if fs.get_file_info(t).type == pafs.FileType.Directory:
                fs.delete_dir(t)


def _move(fs: pafs.FileSystem, part: str, final: str) -> None:
    """A rename that may be repeated: where only the target is left, an earlier attempt has done it."""
    if fs.get_file_info(part).type == pafs.FileType.NotFound and fs.get_file_info(final).type == pafs.FileType.File:
        return
    fs.create_dir(os.path.dirname(final), recursive=True)
    fs.move(part, final)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        payload = self.options.get("payload", "false").lower() == "true"
        meta = payload or self.options.get("meta", "false").lower() == "true"
        return INDEX_DDL + (", meta string" if meta else "") + (", data binary" if payload else "")

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), schema)


def register(spark) -> None:
    """Make the format known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def prepare(rows, container: str = "container", order: str = "name"):
    """Deal rows to tasks by container and sort them within, as the sink needs them. More containers, more tasks: a day's shards bound a container's size."""
    return rows.repartition(container).sortWithinPartitions(container, order)


def footers(spark, path: str, day: str | None = None):
    """One row per archive: path, size, footer fields, entry and distinct counts, and the fault if it is none. Reads directories only, in tasks."""
    found = spark.createDataFrame(containers_under(path, day), "container string, size long")
    fields = ["version", "data_start", "data_length", "meta_start", "meta_length", "index_start", "index_length", "file_count"]

    def run(batches):
        fs, _ = file_system(path)
        for batch in batches:
            rows = []
            for p, size in zip(batch.column("container").to_pylist(), batch.column("size").to_pylist(), strict=True):
                row = dict.fromkeys(fields) | {"container": p, "size": size, "distinct_count": None, "error": None}
                try:
                    with fs.open_input_file(p) as f:
                        footer, entries = read_directory(f, size)
                    row |= {k: getattr(footer, k) for k in fields} | {"distinct_count": len({e.name for e in entries})}
                except (codec.ArchiveError, OSError, UnicodeDecodeError) as e:
                    row["error"] = str(e)
                rows.append(row)
            names = ["container", "size", *fields, "distinct_count", "error"]
            kinds = [pa.string(), pa.int64(), *[pa.int64()] * len(fields), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return found.repartition(max(1, min(found.sparkSession.sparkContext.defaultParallelism * 4, 1000))).mapInArrow(run, "container string, size long, " + ", ".join(f"{f} long" for f in fields) + ", distinct_count long, error string")


def archive_bytes(members: list[tuple[str, bytes, dict | None]], **options) -> bytes:
    """An archive in memory, for small uses."""
    out = io.BytesIO()
    w = codec.Writer(out, **options)
    for name, data, meta in members:
        w.add(name, data, meta)
    w.finish()
    return out.getvalue()
