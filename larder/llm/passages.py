"""Documents that share a passage: fingerprints of word windows, winnowed, and found in two documents or more.

Of every few neighbouring windows of words the one with the least fingerprint is kept, so that two
documents with a long enough passage in common keep the same window of it. Fingerprints are
dealt to buckets by range. A task first settles what its own documents share and passes on one document
for each fingerprint, so a passage that a third of all documents hold costs a row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, by_bucket, document, mix64, shuffle_parts
from .prints import Prints, word_prints

#: A shared passage of so many words is always found, one of fewer than WORDS - SLACK never.
WORDS, SLACK = 50, 5
_FLUSH = 1_000_000


def window_names(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit names of all runs of n words, given by their names."""
    m = len(words)
    if m < n:
        return words[:0]
    up, down = Prints.powers(0, m + 1)
    with np.errstate(over="ignore"):
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words) * up[:m])])
        return mix64((s[n:] - s[:-n]) * down[: m - n + 1])


def winnow(names: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """Places of the names that are the least (the last of equal ones) of some w neighbours of their document; of shorter documents of all."""
    n = len(names)
    keep = np.zeros(n, bool)
    size = np.bincount(doc, minlength=int(doc[-1]) + 1 if n else 0)
    ends = np.cumsum(size)
    start = np.arange(n)
    whole = start + w <= ends[doc]
    least = np.where(whole, start, -1)
    for i in range(1, w):
        at = np.minimum(start + i, n - 1)
        better = whole & (names[at] <= names[np.maximum(least, 0)])
        least = np.where(better, at, least)
    keep[least[whole]] = True
    for d in np.flatnonzero((size > 0) & (size < w)):
        a, b = ends[d] - size[d], ends[d]
        keep[b - 1 - np.argmin(names[a:b][::-1])] = True
    return np.flatnonzero(keep)


def _fingerprints(words: int, slack: int, buckets: int):
    k, w = words - slack, slack + 1

    def flush(names, docs) -> pa.RecordBatch:
        names, docs = np.concatenate(names), np.concatenate(docs)
        order = np.lexsort((docs, names))
        names, docs = names[order], docs[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        last = np.append(first[1:], len(names)) - 1
        several = docs[first] != docs[last]  # docs are sorted within a name
        shared = np.unique(docs[np.repeat(several, last - first + 1)])
        names, docs = names[first], docs[first]
        cut = np.searchsorted((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
        rows = [(i, names[a:b].tobytes(), docs[a:b].tobytes()) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
        rows += [(int(part[0] % buckets), b"", part.tobytes()) for part in np.array_split(shared, -(-len(shared) // 4096)) if len(part)] if len(shared) else []
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "names", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, docs, got = [], [], 0
        for batch, texts in blocks(batches, size=1 << 20):
            word, size = word_prints(texts)
            row = np.repeat(np.arange(len(texts)), size)
            name = window_names(word, k)
            ok = np.arange(len(name)) + k <= np.cumsum(size)[row[: len(name)]]
            name, row = name[ok], row[: len(ok)][ok]
            at = winnow(name, row, w)
            names.append(name[at])
            docs.append(batch.column("doc").to_numpy()[row[at]])
            got += len(at)
            if got > _FLUSH:
                yield flush(names, docs)
                names, docs, got = [], [], 0
        if got:
            yield flush(names, docs)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, docs, out = [], [], []
    for batch in batches:
        for n, d in zip(batch.column("names").to_pylist(), batch.column("docs").to_pylist(), strict=True):
            if n:
                names.append(np.frombuffer(n, np.uint64))
                docs.append(np.frombuffer(d, np.int64))
            else:
                out.append(np.frombuffer(d, np.int64))
    if names:
        names, docs = np.concatenate(names), np.concatenate(docs)
        order = np.lexsort((docs, names))
        names, docs = names[order], docs[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        last = np.append(first[1:], len(names)) - 1
        out.append(docs[np.repeat(docs[first] != docs[last], last - first + 1)])
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], ["doc"])


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, slack: int = SLACK) -> DataFrame:
    """Ids (``doc``, a long) of the documents that share ``words`` words in a row, lower-cased, with another one; none for fewer than ``words - slack``.

    Texts that are null, empty or shorter share nothing; rows with one id are one document and a null id
    counts as the largest number; very long texts are handled whole; columns other than the two named are not read.
    """
    parts = shuffle_parts(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(document(docs, id_col).alias("doc"), text.alias("text"))
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = parts * max(1, -(-size // (parts * 100_000_000)))
    rows = by_bucket(keyed.mapInArrow(_fingerprints(words, slack, buckets), "bucket int, names binary, docs binary"), buckets)
    return rows.mapInArrow(_meet, "doc long").distinct()
