"""Exact removal of long repeated substrings by sparse distributed prefix doubling.

Positions are named instead of ranked: a name is a fingerprint of the bytes that follow, and the name
of a doubled length is made from the pair of names at a position and at the offset. Spark sorts and
groups the names at growing lengths; positions whose name has become unique are dropped, those equal
past the threshold are repeats. To stay far below one row a byte, doubling runs over anchors: every
window of ``length`` bytes elects the position of its least fingerprint, so equal windows elect
equal anchors. What is left between unique and repeated is refined: from the windows of an anchor to
units of neighbouring windows, and from those to single windows. A unit is unique where the bytes all
its windows share are unique, and repeated where the bytes of all its windows together are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, document, forget, meet, mix64, release, steady, written
from .prints import Prints

LENGTH = 400
#: Bytes of text handled at once; a byte takes some 150 bytes of memory meanwhile.
BLOCK = 1 << 20
#: Windows in a unit.
UNIT = 32


def _sliding_least(keys: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours."""
    n = len(keys)
    pad = -n % w
    grid = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], ends]).astype(np.int64)


def anchors(raw: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Prints]:
    """Runs of windows that elect one anchor: document number, anchor, first and last window start, all as places in the buffer."""
    prints = Prints(raw)
    k = length // 8
    w = length - k + 1
    empty = np.zeros(0, np.int64)
    if len(raw) < length:
        return empty, empty, empty, empty, prints
    place = np.arange(len(raw) - k + 1, dtype=np.uint64)
    bits = np.uint64(max(1, int(len(raw)).bit_length()))
    names = prints.of(place.astype(np.int64), k)
    least = _sliding_least((names >> bits << bits) | place, w)
    elected = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(elected))
    doc = np.searchsorted(bounds, starts, side="right") - 1
    ok = starts + length <= bounds[doc + 1]
    starts, doc, elected = starts[ok], doc[ok], elected[ok]
    if not len(starts):
        return empty, empty, empty, empty, prints
    new = np.ones(len(starts), bool)
    new[1:] = (elected[1:] != elected[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return doc[first], elected[first], starts[first], starts[last], prints


def _signed(x: np.ndarray, bad: np.ndarray | None = None) -> pa.Array:
    return pa.array(x.view(np.int64), mask=bad)


def _find(length: int):
    k = length // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, size=BLOCK):
            for row, shift, pieces in _pieces(texts, length):
                raw, bounds = _layout(pieces)
                doc, a, p0, p1, prints = anchors(raw, bounds, length)
                if not len(a):
                    continue
                end, begin, idx = bounds[doc + 1], bounds[doc] - shift[doc], pa.array(row[doc])
                cols = [batch.column("doc").take(idx), batch.column("mark").take(idx), pa.array((a - begin).astype(np.int32)), pa.array((p0 - begin).astype(np.int32)), pa.array((p1 - begin).astype(np.int32)), _signed(prints.of(a, k))]
                for h in (k, 2 * k):  # the name of twice the length, from the pair of names at the place and at the offset
                    short = a + 2 * h > end
                    left, right = prints.of(a, np.where(short, 0, h)), prints.of(np.where(short, a, a + h), np.where(short, 0, h))
                    with np.errstate(over="ignore"):
                        cols.append(_signed(mix64(left * np.uint64(3) + right), short))
                size = p1 - p0 + length
                cols += [_signed(prints.of(p0, size)), _signed(prints.of(p0, size, 1))]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "mark", "a", "p0", "p1", "n0", "n1", "n2", "c1", "c2"])

    return run


def _pieces(texts: list[bytes], length: int):
    """The texts as they are, or a very long one in pieces that overlap, so that every window lies in one: rows, shifts and bytes of the pieces to lay out together."""
    if len(texts) > 1 or not texts or len(texts[0]) <= 2 * BLOCK:
        yield np.arange(len(texts)), np.zeros(len(texts), np.int64), texts
        return
    t = texts[0]
    for at in range(0, len(t) - length + 1, BLOCK):
        yield np.zeros(1, np.int64), np.array([at]), [t[at : at + BLOCK + length - 1]]


def _expand(length: int, unit: int):
    """Units (or, for unit 1, windows) of the runs listed with each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, size=BLOCK):
            todo = batch.column("todo")
            counts = np.diff(todo.offsets.to_numpy())
            flat = todo.flatten()
            runs = [flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            owner = np.repeat(np.arange(len(texts)), counts)
            if len(texts) > 1 or len(texts[0]) <= 2 * BLOCK:
                yield from _units(batch, texts, np.zeros(len(texts), np.int64), np.array([len(t) for t in texts]), owner, *runs)
                continue
            t = texts[0]
            for part in np.unique(runs[0] // BLOCK):  # a very long text, a stretch of anchors at a time
                own = runs[0] // BLOCK == part
                a, p0, p1 = (x[own] for x in runs)
                low = max(0, int(p0.min()) - 2 * unit)
                yield from _units(batch, [t[low : int(p1.max()) + length + 2 * unit]], np.array([low]), np.array([len(t)]), owner[own], a, p0, p1)

    def _units(batch, texts, shift, sizes, doc, a, p0, p1) -> Iterator[pa.RecordBatch]:
        raw, bounds = _layout(texts)
        prints = Prints(raw)
        lo_g, hi_g = (a - p1) // unit, (a - p0) // unit
        n = hi_g - lo_g + 1
        for at in range(0, len(a), 20_000):
            s = slice(at, at + 20_000)
            row = np.repeat(np.arange(len(a))[s], n[s])
            g = np.arange(n[s].sum()) - np.repeat(np.cumsum(n[s]) - n[s], n[s]) + lo_g[row]
            begin = bounds[doc[row]] - shift[doc[row]]
            high, low = a[row] - unit * g, a[row] - unit * g - unit + 1
            own_low, own_high = np.maximum(low, p0[row]), np.minimum(high, p1[row])
            core = mix64(prints.of(begin + high, low + length - high) ^ g.astype(np.uint64))
            outside = (low < 0) | (high + length > sizes[doc[row]])
            x0, x1 = np.where(outside, 0, begin + low), np.where(outside, 0, high - low + length)
            idx = pa.array(doc[row])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(idx), batch.column("mark").take(idx), pa.array(a[row].astype(np.int32)), pa.array(own_low.astype(np.int32)), pa.array(own_high.astype(np.int32)), _signed(core), _signed(prints.of(x0, x1), outside), _signed(prints.of(x0, x1, 1), outside)],
                ["doc", "mark", "a", "p0", "p1", "n0", "c1", "c2"],
            )

    return run


def _clip(id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, size=BLOCK):
            sizes, removed, spans, kept = [], [], [], []
            for t, own in zip(texts, batch.column("spans").to_pylist(), strict=True):
                merged: list[dict] = []
                for x in sorted(own or (), key=lambda x: (x["s"], x["e"])):
                    if merged and x["s"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], x["e"])
                    else:
                        merged.append({"start": x["s"], "end": x["e"]})
                at, parts = 0, []
                for x in merged:
                    parts.append(t[at : x["start"]])
                    at = x["end"]
                parts.append(t[at:])
                rest = b"".join(parts)
                sizes.append(len(t))
                removed.append(len(t) - len(rest))
                spans.append(merged)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column(id_name), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], [id_name, "n_bytes", "n_removed", "spans", "kept"])

    return run


def _repeated(df: DataFrame, *cols: str) -> DataFrame:
    """Values found more than once, written: a join with a table is one whose skewed keys Spark can split."""
    return written(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*cols), "repeated")


def _classes(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of entries equal in all their bytes to another; and one entry of each class that has others to be told from."""
    key = ["c1", "c2", "reach", "width"]
    live = live.withColumns({"reach": F.col("a") - F.col("p0"), "width": F.col("p1") - F.col("p0")})
    whole = live.where("c1 IS NOT NULL").groupBy(*key, "n0").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "mark", "a", "p0", "p1")).alias("one"))
    whole = written(whole, "classes")
    same = live.join(whole.where("n > 1").select(*key, "n0"), [*key, "n0"], "left_semi").select("doc", "mark", "p0", "p1")
    ones = whole.select("n0", "one").unionByName(live.where("c1 IS NULL").select("n0", F.struct("doc", "mark", "a", "p0", "p1").alias("one")))
    mixed = ones.join(_repeated(ones.select("n0"), "n0"), "n0", "left_semi").select("one.*")
    return same, mixed


def _lists(todo: DataFrame) -> DataFrame:
    return todo.groupBy("doc", "mark").agg(F.collect_list(F.struct("a", "p0", "p1")).alias("todo"))


def _positions(step: int):
    """Every position of the texts with the name of the ``step`` bytes from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, size=BLOCK):
            for row, shift, pieces in _pieces(texts, step):
                raw, bounds = _layout(pieces)
                start = np.arange(max(len(raw) - step + 1, 0))
                doc = np.searchsorted(bounds, start, side="right") - 1
                start, doc = start[start + step <= bounds[doc + 1]], doc[start + step <= bounds[doc + 1]]
                idx = pa.array(row[doc])
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(idx), batch.column("mark").take(idx), batch.column("times").take(idx), pa.array((start - bounds[doc] + shift[doc]).astype(np.int32)), _signed(Prints(raw).of(start, step))], ["doc", "mark", "times", "pos", "rank"])

    return run


def repeated_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, rounds: int = 4) -> DataFrame:
    """Where strings of ``length`` bytes begin that also begin elsewhere: doc, mark, pos; by prefix doubling over every position.

    The first ranks name length / 2^rounds bytes. In each round the pairs of ranks at a position and at the
    offset are sorted into classes, classes of one position are dropped, and the others numbered anew.
    A row a byte is shuffled several times, so this is for tables that are small against the cluster; ``remove_repeats``
    finds the same by far fewer rows.
    """
    step = length >> rounds
    if step << rounds != length:
        raise ValueError("length must be a multiple of 2^rounds")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(document(docs, id_col).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text")).groupBy("doc", "mark", "text").agg(F.count(F.lit(1)).alias("times"))
    live = written(keyed.mapInArrow(_positions(step), "doc long, mark long, times long, pos int, rank long"), "ranks")
    while step < length:
        at = live.select("doc", "mark", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = written(live.join(at, ["doc", "mark", "pos"]), "pairs")
        classes = written(pairs.groupBy("rank", "next").agg(F.sum("times").alias("n")).where("n > 1").select("rank", "next", F.monotonically_increasing_id().alias("again")), "classes")
        ranked = written(pairs.join(classes, ["rank", "next"]).select("doc", "mark", "times", "pos", F.col("again").alias("rank")), "ranks")
        for done in (live, pairs, classes):
            forget(done)
        release(docs.sparkSession)
        live, step = ranked, 2 * step
    return live.select("doc", "mark", "pos")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """One row per document row: id, n_bytes, n_removed, spans (maximal removed runs of bytes), kept (remaining bytes).

    A byte goes if any string of ``length`` bytes over it also starts elsewhere, in any document.
    Null counts as empty; repeated rows are repeats of each other; shorter texts lose nothing; very long ones are
    handled in pieces; an empty table has no rows; ids are integers;
    columns other than the two named are not read.
    """
    spark = docs.sparkSession
    steady(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col), document(docs, id_col).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))
    id_name = keyed.columns[0]
    found = written(keyed.select("doc", "mark", "text").mapInArrow(_find(length), "doc long, mark long, a int, p0 int, p1 int, n0 long, n1 long, n2 long, c1 long, c2 long"), "anchors")
    live = written(found.join(_repeated(found.select("n0"), "n0"), "n0", "left_semi"), "rank0")
    forget(found)
    release(spark)
    for name, size in (("n1", length // 8 * 2), ("n2", length // 8 * 4)):
        # Every window of the anchor holds these bytes, so a unique name ends them all.
        again = _repeated(live.where(F.col(name).isNotNull()).select(name), name).withColumn("_again", F.lit(True))
        live = live.join(again, name, "left").where(F.col("_again") | (F.col("a") + size > F.col("p0") + length)).drop("_again")
    live = written(live.select("doc", "mark", "a", "p0", "p1", "n0", "c1", "c2"), "rank2")
    release(spark)
    same, mixed = _classes(live)
    spans = [same]
    for step in (unit, 1):
        lists = written(_lists(mixed), f"todo{step}")
        parts = meet(keyed.select("doc", "mark", "text"), lists, ["doc", "mark"]).select("doc", "mark", "text", "todo")
        out = written(parts.mapInArrow(_expand(length, step), "doc long, mark long, a int, p0 int, p1 int, n0 long, c1 long, c2 long"), f"unit{step}")
        same, mixed = _classes(out.join(_repeated(out.select("n0"), "n0"), "n0", "left_semi"))
        spans.append(same)
        release(spark)
    every = spans[0].unionByName(spans[1]).unionByName(spans[2])
    cut = written(every.groupBy("doc", "mark").agg(F.collect_set(F.struct(F.col("p0").alias("s"), (F.col("p1") + length).alias("e"))).alias("spans")), "spans")
    joined = meet(keyed, cut, ["doc", "mark"], "left").select(id_name, "text", "spans")
    kind = keyed.schema[id_name].dataType.simpleString()
    return joined.mapInArrow(_clip(id_name), f"{id_name} {kind}, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
