"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each scan partition packs its own documents, so nothing is shuffled. A document's full windows are
cut off at once; its remainder goes to the fill level at which the sum of squared counts of partly
filled windows grows least, which a level array tells. Windows still open when the partition ends
are topped up with pieces cut from the emptiest ones, and what is left after the last full window is
cut into sequences whose lengths are powers of two, so that nothing has to be padded.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

CAPACITY = 2048
END_ID = 1
#: Bits of a sequence id that number the sequences of one partition.
LOCAL_BITS = 36
SCHEMA = "start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the json file beside the ranks; none if there is no such file."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    odd = [x["content"] for x in added if x["single_word"] or x["lstrip"] or x["rstrip"]]
    if odd:
        raise ValueError(f"added tokens that look at their surroundings are not supported: {odd}")
    return {x["content"]: x["id"] for x in added}


@lru_cache(maxsize=2)
def encoder(path: str):
    """The public byte-level vocabulary as an encoder that, like the tokeniser of the json file, finds added tokens inside texts."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class SumOfSquares:
    """The packer. ``add`` takes a document and returns finished pieces; ``close`` returns the rest.

    A piece is (doc, start, length, sequence, offset), doc being whatever was added.
    """

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)  # the level array: open windows by fill
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]  # level -> windows -> pieces
        self.next = 0

    def _emit(self, window: list) -> list[tuple]:
        out, at = [], 0
        for doc, start, length in window:
            out.append((doc, start, length, self.next, at))
            at += length
        self.next += 1
        return out

    def level(self, size: int) -> int:
        """The fill level (0: a new window) at which the sum of squared counts grows least; ties go to the fullest."""
        c, n = self.capacity, self.counts
        target = n[size : c + 1].copy()  # count at the level that results, for fills 0 .. c - size
        delta = 2 * (target - n[: c - size + 1]) + 2
        delta[0] = 2 * n[size] + 1 if size < c else 0
        if size < c:
            delta[-1] = 1 - 2 * n[c - size]
            closed = n[1 : c - size + 1] == 0
            delta[1:][closed] = np.iinfo(np.int64).max
        return int(c - size - np.argmin(delta[::-1]))

    def add(self, doc, tokens: int) -> list[tuple]:
        out, c, start = [], self.capacity, 0
        while tokens - start >= c:
            out += self._emit([(doc, start, c)])
            start += c
        size = tokens - start
        if size:
            f = self.level(size)
            if f:
                window = self.open[f].pop()
                self.counts[f] -= 1
            else:
                window = []
            window.append((doc, start, size))
            if f + size == c:
                out += self._emit(window)
            else:
                self.open[f + size].append(window)
                self.counts[f + size] += 1
        return out

    def close(self) -> list[tuple]:
        windows = [w for level in reversed(self.open) for w in level]
        fills = [sum(p[2] for p in w) for w in windows]
        out, c = [], self.capacity
        lo, hi = 0, len(windows) - 1
        while lo < hi:
            need = c - fills[lo]
            if not need:
                out += self._emit(windows[lo])
                lo += 1
                continue
            doc, start, length = windows[hi].pop()
            take = min(need, length)
            windows[lo].append((doc, start + length - take, take))
            fills[lo] += take
            fills[hi] -= take
            if take < length:
                windows[hi].append((doc, start, length - take))
            elif not windows[hi]:
                hi -= 1
        if lo <= hi and fills[lo]:
            rest, size = windows[lo], fills[lo]
            for k in reversed(range(size.bit_length())):
                part = 1 << k
                if not size & part:
                    continue
                window = []
                while part:
                    doc, start, length = rest.pop()
                    take = min(part, length)
                    window.append((doc, start + length - take, take))
                    if take < length:
                        rest.append((doc, start, length - take))
                    part -= take
                out += self._emit(window)
        self.open = [[] for _ in range(c + 1)]
        self.counts[:] = 0
        return out


def _packer(vocabulary: str, capacity: int, end_id: int, id_col: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        base = TaskContext.get().partitionId() << LOCAL_BITS
        machine = SumOfSquares(capacity)
        kind = None

        def rows(pieces):
            docs = [p[0] for p in pieces]
            cut = [d[1][s : s + n].tobytes() for d, (_, s, n, _, _) in zip(docs, pieces, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in docs], kind), pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()), pa.array(cut if keep_ids else [None] * len(cut), pa.binary()), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array([len(d[1]) for d in docs], pa.int64()), pa.array([base + p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64())],
                [id_col, "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        for batch, texts in blocks(batches):
            kind = batch.column(id_col).type
            done = []
            for doc_id, t in zip(batch.column(id_col).to_pylist(), texts, strict=True):
                ids = np.array(enc.encode(t.decode("utf-8", "replace"), allowed_special="all") + [end_id], "<u4")
                done += machine.add((doc_id, ids), len(ids))
            if done:
                yield rows(done)
        last = machine.close()
        for i in range(0, len(last), 4096):
            yield rows(last[i : i + 4096])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur. Every
    sequence holds ``capacity`` ids, but for at most ``log2(capacity)`` of each scan partition, whose
    lengths are powers of two; an empty table gives no rows. Sequence ids are unique over the
    table. The vocabulary is a file on every machine.
    """
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    id_col = picked.columns[0]
    schema = f"{picked.schema[id_col].simpleString().replace(':', ' ', 1)}, {SCHEMA}"
    return picked.mapInArrow(_packer(vocabulary or default_vocabulary(), capacity, end_id, id_col, keep_ids), schema)
