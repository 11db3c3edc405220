"""Benchmark decontamination by Wu-Manber multi-pattern search over normalised words.

Texts are reduced to words separated by single spaces, so that a window of words is a byte string
with a space at either end. A search keeps a shift table over blocks of bytes: a block that no
pattern has near its end lets the cursor jump; where the shift is zero, the hash of the block (the
suffix) and of the pattern's first bytes (the prefix) select patterns, and a direct comparison
confirms. Cursors of many lanes of the same haystack advance together, a vector at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, number, written

WINDOW = 13
#: A block of benchmark items holds at most this many bytes of text and items; more items take more passes over the documents.
BLOCK_BYTES = 8 << 20
BLOCK_ITEMS = 200_000
_TABLE_BITS = 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SCHEMA = "n_words long, hits array<struct<start:int,length:int>>, n_hit long, items array<long>"


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and characters beyond ASCII."""
    return text.translate(_WORDS).split()


class WuManber:
    """Finds every occurrence of byte strings in a haystack; patterns are searched by classes of similar length."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(patterns):
            if not p:
                raise ValueError("a pattern may not be empty")
            classes.setdefault(min(len(p), 40).bit_length() if len(p) < 40 else 99, []).append(i)
        self.classes = [self._prepare(ids) for _, ids in sorted(classes.items())]

    @staticmethod
    def _slot(v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((v * _MUL) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def _prepare(self, ids: list[int]) -> dict:
        m = min(len(self.patterns[i]) for i in ids)
        b = max(1, min(8, m // 2))
        mask = np.uint64((1 << (8 * b)) - 1)
        shift = np.full(1 << _TABLE_BITS, m - b + 1, dtype=np.int64)
        heads = np.frombuffer(b"".join(self.patterns[i][:m] for i in ids), np.uint8).reshape(len(ids), m).astype(np.uint64)
        for end in range(b, m + 1):
            v = np.zeros(len(ids), np.uint64)
            for j in range(b):
                v |= heads[:, end - b + j] << np.uint64(8 * j)
            np.minimum.at(shift, self._slot(v & mask), m - end)
        buckets: dict[tuple[int, int], list[int]] = {}
        for i in ids:
            p = self.patterns[i]
            buckets.setdefault((int.from_bytes(p[m - b : m], "little"), int.from_bytes(p[:b], "little")), []).append(i)
        with np.errstate(over="ignore"):
            keys = np.unique(np.array([x for x, _ in buckets], np.uint64) * _MUL ^ np.array([y for _, y in buckets], np.uint64))
        return {"m": m, "b": b, "mask": mask, "shift": shift, "buckets": buckets, "keys": keys}

    def search(self, hay: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and pattern numbers of all occurrences."""
        at: list[int] = []
        which: list[int] = []
        raw = hay + b"\0" * 8
        value = np.ndarray((len(hay) + 1,), dtype="<u8", buffer=raw, strides=(1,))
        for c in self.classes:
            m, b = c["m"], c["b"]
            if len(hay) < m:
                continue
            first = m - b  # the cursor is the start of the block that ends a window
            stop = len(hay) - b + 1
            lanes = max(1, min(16384, (stop - first) // 64))
            cur = np.linspace(first, stop, lanes + 1).astype(np.int64)
            end, cur = cur[1:], cur[:-1].copy()
            found = []
            while cur.size:
                v = value[cur] & c["mask"]
                step = c["shift"][self._slot(v)]
                zero = step == 0
                if zero.any():
                    found.append(cur[zero])
                    step[zero] = 1
                cur = cur + step
                live = cur < end
                if not live.all():
                    cur, end = cur[live], end[live]
            if not found:
                continue
            pos = np.concatenate(found)
            start = pos - (m - b)
            suffix, prefix = value[pos] & c["mask"], value[start] & c["mask"]
            with np.errstate(over="ignore"):
                key = suffix * _MUL ^ prefix
            k = np.minimum(np.searchsorted(c["keys"], key), len(c["keys"]) - 1)
            ok = c["keys"][k] == key
            for s, x, y in zip(start[ok].tolist(), suffix[ok].tolist(), prefix[ok].tolist(), strict=True):
                for i in c["buckets"].get((x, y), ()):
                    p = self.patterns[i]
                    if hay[s : s + len(p)] == p:
                        at.append(s)
                        which.append(i)
        return np.array(at, np.int64), np.array(which, np.int64)


def windows_of(items: list[tuple[int, bytes]], window: int = WINDOW) -> tuple[list[bytes], list[set[int]], list[int]]:
    """Distinct windows of the items as byte strings, the items of each and its number of words."""
    by: dict[bytes, set[int]] = {}
    size: dict[bytes, int] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            p = b" " + b" ".join(w[i : i + window]) + b" "
            by.setdefault(p, set()).add(item)
            size[p] = min(window, len(w))
    return list(by), list(by.values()), [size[p] for p in by]


def _searcher(items: list[tuple[int, bytes]], window: int, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, owners, sizes = windows_of(items, window)
        machine = WuManber(patterns)
        sizes_of = np.array(sizes, np.int64)
        for batch, texts in blocks(batches):
            split = [words(t) for t in texts]
            hay = b"\n".join(b" " + b" ".join(w) + b" " for w in split)
            at, which = machine.search(hay)
            n_words = [len(w) for w in split]
            spans: list[list] = [[] for _ in split]
            hit = [0] * len(split)
            items_of: list[list[int]] = [[] for _ in split]
            if at.size:
                raw = np.frombuffer(hay, np.uint8)
                spaces = np.flatnonzero(raw == 32)
                starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
                doc = np.searchsorted(starts, at, side="right") - 1
                word = np.searchsorted(spaces, at) - np.searchsorted(spaces, starts[doc])
                order = np.lexsort((word, doc))
                for i in order.tolist():
                    d, s, n = int(doc[i]), int(word[i]), int(sizes_of[which[i]])
                    items_of[d].extend(owners[which[i]])
                    own = spans[d]
                    if own and s <= own[-1]["start"] + own[-1]["length"]:
                        own[-1]["length"] = max(own[-1]["length"], s + n - own[-1]["start"])
                    else:
                        own.append({"start": s, "length": n})
                hit = [sum(x["length"] for x in own) for own in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array(hit, pa.int64()), pa.array([sorted(set(x)) for x in items_of], pa.list_(pa.int64()))],
                [id_col, "n_words", "hits", "n_hit", "items"],
            )

    return run


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    """Benchmark items in blocks of bounded size, streamed partition by partition."""
    block: list[tuple[int, bytes]] = []
    size = 0
    for r in benchmark.select(number(benchmark, item_col), F.col(text_col).cast("string")).where(F.col(item_col).isNotNull()).toLocalIterator():
        t = (r[1] or "").encode()
        if block and (size + len(t) > BLOCK_BYTES or len(block) >= BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((r[0], t))
        size += len(t)
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document row: id, n_words, hits (merged word spans), n_hit, items (ascending ids of items with occurring windows).

    Null and empty texts have no words; null item ids are ignored, item ids are integers; a repeated document
    row gets a row of its own; without benchmark items every document is clean, without documents there are no rows;
    very long texts are searched whole. Columns other than the named ones
    are not read. One block of items (the usual case) is one narrow pass over the documents; further
    blocks of a large benchmark take a pass each and are merged by row.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    id_col = picked.columns[0]
    schema = f"{picked.schema[id_col].simpleString().replace(':', ' ', 1)}, {SCHEMA}"
    passes = []
    for block in item_blocks(benchmark, item_col, item_text_col):
        carried = spark.sparkContext.broadcast(block)  # bounded by BLOCK_BYTES and BLOCK_ITEMS
        passes.append(picked.mapInArrow(_lazy(carried, window, id_col), schema))
    if len(passes) == 1:
        return passes[0]
    # A row's number is its place in its scan partition, alike in every pass; ids may repeat.
    numbered = [p.withColumn("_row", F.monotonically_increasing_id()) for p in passes]
    every = written(_union(numbered), "decontaminate")
    spread = every.select(id_col, "_row", "n_words", "items", F.explode_outer("hits").alias("h"))
    covered = (
        spread.groupBy(F.col(id_col), "_row")
        .agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("h")).alias("raw"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    merged = F.expr(
        "aggregate(raw, cast(array() as array<struct<start:int,length:int>>), (a, h) -> CASE WHEN size(a) = 0 OR h.start > element_at(a, -1).start + element_at(a, -1).length THEN concat(a, array(h)) "
        "ELSE concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'length', greatest(element_at(a, -1).length, h.start + h.length - element_at(a, -1).start)))) END)"
    )
    return covered.withColumn("hits", merged).select(id_col, "n_words", "hits", F.expr("aggregate(hits, 0L, (s, h) -> s + h.length)").alias("n_hit"), "items")


def _lazy(carried, window: int, id_col: str):
    return lambda batches: _searcher(carried.value, window, id_col)(batches)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def contaminated(n_hit, n_words):
    """More than nothing, and a twentieth of the words or more, are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
