"""Line dedup: range-partitioned line hashes, secondary sort, keep bitmaps.

A line's key is hashed to 128 bits. The hashes are range-partitioned and sorted by hash, document
and position; one pass over each sorted partition streams first occurrences. Ranges include the
document, so a line that a third of all documents hold spreads over many partitions; a partition's
first and last hash are settled among the partitions by a table of at most two rows for each.
Documents then carry compressed bitmaps of the lines to keep; text moves only where a caller wants it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import blocks, document, meet, shuffle_parts, steady, written

MIN_CHARS = 10
_SPACE = b" \t\n\v\f\r"


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line's key, or None where it is too short to count."""
    k = line.strip(_SPACE)
    if len(k) < min_chars or len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars:
        return None
    return k.lower()


def _hasher(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            row, at, dig = [], [], []
            for i, t in enumerate(texts):
                for j, line in enumerate(t.split(b"\n")):
                    k = key_of(line, min_chars)
                    if k is not None:
                        row.append(i)
                        at.append(j)
                        dig.append(xxhash.xxh3_128_digest(k))
            if row:
                h = np.frombuffer(b"".join(dig), "<i8").reshape(-1, 2)
                idx = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("doc").take(idx), batch.column("mark").take(idx), pa.array(at, pa.int32())], ["h1", "h2", "doc", "mark", "pos"])

    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a sorted partition: rows that are not in the first document of their hash, and all of the first hash; with the first document seen here."""
    head = None
    last = None
    first = 0
    tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc"))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = last != (h1[0], h2[0])
        group = np.cumsum(new)
        firsts = np.concatenate([[first], doc[new]])[group]
        if head is None:
            head = (h1[0], h2[0])
        is_head = (h1 == head[0]) & (h2 == head[1])
        keep = is_head | (doc != firsts)
        last, first = (h1[-1], h2[-1]), firsts[-1]
        tail = (h1[-1], h2[-1], firsts[-1])
        if keep.any():
            k = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column("h1").take(k), batch.column("h2").take(k), batch.column("doc").take(k), batch.column("mark").take(k), batch.column("pos").take(k), pa.array(firsts[keep]), pa.array(is_head[keep])], ["h1", "h2", "doc", "mark", "pos", "first", "edge"])
    if tail is not None:  # no line of a document: only tells the next partition which document was first
        yield pa.RecordBatch.from_arrays([pa.array([tail[0]]), pa.array([tail[1]]), pa.array([tail[2]]), pa.array([0], pa.int64()), pa.array([-1], pa.int32()), pa.array([tail[2]]), pa.array([True])], ["h1", "h2", "doc", "mark", "pos", "first", "edge"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, n = [], []
        for drop in batch.column("drops").to_pylist():
            drop = np.array(sorted(set(drop)))
            bits = np.ones(-(-(drop[-1] + 1) // 8) * 8, np.uint8)
            bits[drop] = 0
            out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            n.append(len(drop))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), pa.array(out, pa.binary()), pa.array(n, pa.int64())], ["doc", "mark", "keep", "n_dropped"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in blocks(batches, "text"):
        kept, lines, gone = [], [], []
        for t, zipped in zip(texts, batch.column("keep").to_pylist(), strict=True):
            if zipped is None:
                kept.append(t)
                lines.append(t.count(b"\n") + 1)
                gone.append(0)
                continue
            own = t.split(b"\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(zipped), np.uint8), bitorder="little")
            stay = [x for i, x in enumerate(own) if i >= len(bits) or bits[i]]
            kept.append(b"\n".join(stay))
            lines.append(len(own))
            gone.append(len(own) - len(stay))
        out = pa.array(kept, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("row"), out, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], ["row", "kept_text", "n_lines", "n_dropped"])


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Key and text of each row; its id and what is carried in one column, so that no names can clash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate((id_col, *carry))])
    return docs.select(document(docs, id_col).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"), row.alias("row"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents that lose lines: doc (id; a null id counts as the largest), mark (hash of the text), keep (zlib of a little-endian bitmap: bit i set if line i stays; lines beyond it stay), n_dropped.

    Empty and null texts have one empty line, which is too short to go.
    """
    spark = docs.sparkSession
    steady(spark)
    n = shuffle_parts(spark)
    lines = _keyed(docs, id_col, text_col).select("doc", "mark", "text").mapInArrow(_hasher(min_chars), "h1 long, h2 long, doc long, mark long, pos int")
    dealt = lines.repartitionByRange(n, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
    marks = written(dealt.mapInArrow(_stream, "h1 long, h2 long, doc long, mark long, pos int, first long, edge boolean"), "linededup")
    firsts = marks.where("edge").groupBy("h1", "h2").agg(F.min("first").alias("true_first"))  # two rows a partition at most
    edges = marks.where("edge AND pos >= 0").join(F.broadcast(firsts), ["h1", "h2"]).where("doc <> true_first")
    drops = marks.where("NOT edge").select("doc", "mark", "pos").unionByName(edges.select("doc", "mark", "pos"))
    return drops.groupBy("doc", "mark").agg(F.collect_set("pos").alias("drops")).mapInArrow(_bitmaps, "doc long, mark long, keep binary, n_dropped long")


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """As ``dedup_lines``, with the id and the carried columns as the fields c0, c1 and so on of one column ``row``."""
    maps = written(keep_bitmaps(docs, id_col, text_col, min_chars).select("doc", "mark", "keep"), "bitmaps")
    joined = meet(_keyed(docs, id_col, text_col, carry), maps, ["doc", "mark"], "left").select("row", "text", "keep")
    kinds = StructType([joined.schema["row"], StructField("kept_text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return joined.mapInArrow(_apply, kinds)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: id, the carried columns, kept_text, n_lines (before), n_dropped. Columns not named are not read.

    Lines whose key has ``min_chars`` code points or more and occurs in two documents or more stay
    only in the smallest document id that holds it (in all its rows, if the id repeats). Ids are integers, null
    counts as the largest. Null text: one empty line. Very long texts are handled whole, an empty table has no
    rows, and a carried column may have any name (of an output too: then the columns are told by their place).
    """
    out = dedup_rows(docs, id_col, text_col, min_chars, carry)
    names = docs.select(F.col(id_col), *carry).columns
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], "kept_text", "n_lines", "n_dropped")
