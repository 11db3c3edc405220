"""An Elias-Fano n-gram trie in shards: built by Spark jobs, memory-mapped by the tasks that answer from it.

The first level holds the words as hashes in ranges. Above it the trie is cut by its first words into
shards; a very frequent first word's children are spread over several. A shard holds, for every parent
node, its next words. All levels are monotone sequences in Elias-Fano form: hashes and ids, pointers
from a parent to its children, and children made monotone by adding the last value of the range before.
A child is found by the successor of (base of its context + word) in that sequence. Probabilities are
absolute-discounted shares, interpolated along the context, quantised to 16 bits; the first level keeps
its counts and is smoothed by half a count.

No task holds the model, and none is sent to all. Texts become chunks of tokens, written once. A
chunk asks the ranges of the first level for its distinct words, and the shards for its distinct n-grams as
a small trie of its own, with how often each occurs in texts that train. A range or shard adds up what all chunks
tell, lays its part of the model out in a file, maps it, and answers every chunk from it. So counts
of all orders are taken over all training texts, and every n-gram travels once a chunk.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, crc_mod, forget, mix64, release, shuffle_parts, steady, trim, written
from .prints import word_prints

ORDER = 3
#: An n-gram of two words or more is kept from this count on; the mass of others goes to the lower orders. 1 keeps all.
MIN_COUNT = 1
DISCOUNT = 0.75
FOLDS, HELD_OUT = 5, 1
#: Tokens of a chunk, and of a shard, about.
CHUNK, SHARD = 1_500_000, 3_000_000
#: N-grams of a shard that are sorted, laid out or looked up together; their temporary arrays are several times as large.
_BLOCK = 1 << 19
#: Quantised log10 values are steps of 2^-12 below zero; NONE stands for no probability at all.
_STEP = 4096.0
NONE = np.uint16(65535)
_U64 = np.uint64


# --- Elias-Fano sequences ---------------------------------------------------------------------


def _bits_of(n: int, universe: int) -> int:
    return max(0, min(56, (max(universe, 1) // max(n, 1)).bit_length() - 1))


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """A monotone sequence below ``universe``: low bits packed, high bits in unary, ones counted by word."""
    n, low_bits = len(values), _bits_of(len(values), universe)
    low = np.zeros(n * low_bits // 64 + 2, _U64)
    size = n + ((universe - 1) >> low_bits if universe else 0) + 2
    high = np.zeros(size // 64 + 1, _U64)
    for begin in range(0, n, _BLOCK):
        v = values[begin : begin + _BLOCK].astype(_U64)
        i = np.arange(begin, begin + len(v), dtype=_U64)
        if low_bits:
            part = v & ((_U64(1) << _U64(low_bits)) - _U64(1))
            at = i * _U64(low_bits)
            word, shift = (at >> _U64(6)).astype(np.int64), at & _U64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + _U64(low_bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U64(64) - shift[over]))
        one = (v >> _U64(low_bits)) + i
        np.bitwise_or.at(high, (one >> _U64(6)).astype(np.int64), _U64(1) << (one & _U64(63)))
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
    return {"meta": np.array([n, low_bits], np.int64), "low": low, "high": high, "ones": ones.astype(np.uint32 if n < 1 << 32 else np.uint64)}


def _select(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th one of each word."""
    word, r, at = word.copy(), r.copy(), np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        c = np.bitwise_count(word & _U64((1 << width) - 1)).astype(np.int64)
        go = r >= c
        r -= np.where(go, c, 0)
        word = np.where(go, word >> _U64(width), word)
        at += np.where(go, width, 0)
    return at


class EliasFano:
    """A sequence made by ``encode``; its arrays may be mapped."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.low_bits = (int(x) for x in parts["meta"])
        self.high, self.ones = parts["high"], parts["ones"]
        raw = parts["low"]
        self._bytes = np.ndarray((max(raw.nbytes - 8, 1),), "<u8", raw.data if raw.flags.c_contiguous else raw.copy().data, strides=(1,))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones.astype(np.int64)

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U64)
        at = i.astype(np.int64) * self.low_bits
        return (self._bytes[at >> 3] >> (at & 7).astype(_U64)) & _U64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select(self.high[word], i - self.ones[word].astype(np.int64))
        return ((place - i).astype(_U64) << _U64(self.low_bits)) | self.low(i)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From which place to which values have this high part: the ones between a zero and the next."""
        z = np.minimum(high - 1, self.zeros[-1] - 1)
        word = np.searchsorted(self.zeros, z, side="right") - 1
        word[high <= 0] = 0
        place = word * 64 + np.where(high <= 0, -1, _select(~self.high[word], np.maximum(z - self.zeros[word], 0)))
        lo = np.where(high <= 0, 0, place - z)
        after = place + 1
        word, bit = after >> 6, (after & 63).astype(_U64)
        run = ~(self.high[np.minimum(word, len(self.high) - 1)] >> bit)  # its lowest one ends the run of ones
        ones = np.bitwise_count((run & (~run + _U64(1))) - _U64(1)).astype(np.int64)
        hi = lo + ones
        over = np.flatnonzero(ones >= 64 - bit.astype(np.int64))  # the run goes on in the next word
        if len(over):
            z = np.minimum(np.maximum(high[over], 0), self.zeros[-1] - 1)
            word = np.searchsorted(self.zeros, z, side="right") - 1
            hi[over] = word * 64 + _select(~self.high[word], z - self.zeros[word]) - z
        return np.minimum(lo, self.n), np.minimum(hi, self.n)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value >= x, and whether it equals x; sorted or not."""
        high = (x >> _U64(self.low_bits)).astype(np.int64)
        lo, hi = self._bucket(high)
        end, want = hi.copy(), x & _U64((1 << self.low_bits) - 1)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self.low(mid) < want[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        found = lo < end
        found[found] = self.low(lo[found]) == want[found]
        return lo, found


# --- segments, written as bytes and mapped ------------------------------------------------------


def _pieces(parts: dict[str, np.ndarray]) -> Iterator[bytes]:
    head, at = {}, 0
    for k, a in parts.items():
        head[k] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 8) * 8
    h = json.dumps(head).encode()
    h += b" " * (-len(h) % 8)
    yield len(h).to_bytes(8, "little") + h
    for a in parts.values():
        yield np.ascontiguousarray(a).tobytes()
        yield b"\0" * (-a.nbytes % 8)


def pack(parts: dict[str, np.ndarray]) -> bytes:
    return b"".join(_pieces(parts))


def unpack(raw: np.ndarray) -> dict[str, np.ndarray]:
    n = int(raw[:8].view("<u8")[0])
    body = raw[8 + n :]
    return {k: body[at : at + np.dtype(t).itemsize * m].view(t) for k, (t, at, m) in json.loads(raw[8 : 8 + n].tobytes()).items()}


def squeeze(parts: dict[str, np.ndarray]) -> bytes:
    """Packed and compressed, the bytes of each array by their place in its numbers."""
    planes = {f"{k}|{v.dtype.str}": np.ascontiguousarray(v).view(np.uint8).reshape(-1, v.itemsize).T.ravel() for k, v in parts.items()}
    return zstandard.ZstdCompressor(level=3).compress(pack(planes))


def expand(raw: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, v in unpack(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)).items():
        k, kind = name.split("|", 1)
        kind = np.dtype(kind)
        out[k] = np.ascontiguousarray(v.reshape(kind.itemsize, -1).T).view(kind).ravel()
    return out


def _small(a: np.ndarray) -> np.ndarray:
    """In the smallest unsigned type that holds the values."""
    return a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)


def distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs of numbers that are not negative, and for each pair given its place among them. Pairs and places are sorted as one number where they fit."""
    n = len(high)
    if not n:
        return high.astype(np.int64), low.astype(np.int64), np.zeros(0, np.int32)
    low_bits, place_bits = int(low.max()).bit_length(), n.bit_length()
    if int(high.max()).bit_length() + low_bits + place_bits > 64:
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        back = np.empty(n, np.int64)
        back[order] = np.cumsum(new) - 1
        return high[new].astype(np.int64), low[new].astype(np.int64), back
    one = high.astype(_U64)
    one <<= _U64(low_bits)
    one |= low.astype(np.uint32 if low_bits <= 32 else _U64)
    one <<= _U64(place_bits)
    one |= np.arange(n, dtype=np.uint32 if place_bits <= 32 else _U64)
    one.sort()
    place = one & _U64((1 << place_bits) - 1)
    one >>= _U64(place_bits)  # now the pairs
    new = np.ones(n, bool)
    np.not_equal(one[1:], one[:-1], out=new[1:])
    rank = np.cumsum(new, dtype=np.int32 if place_bits < 32 else np.int64)
    rank -= 1
    back = np.empty(n, rank.dtype)
    back[place.view(np.int64)] = rank
    del place, rank
    one = one[new]
    return (one >> _U64(low_bits)).astype(np.int64), (one & _U64((1 << low_bits) - 1)).astype(np.int64), back


def _under(parts: dict[str, np.ndarray], name: str) -> dict[str, np.ndarray]:
    return {k.split(".", 1)[1]: v for k, v in parts.items() if k.startswith(f"{name}.")}


def _named(name: str, parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in parts.items()}


def quantise(share: np.ndarray) -> np.ndarray:
    """Shares as steps of their logarithm; 0 as NONE."""
    with np.errstate(divide="ignore"):
        return np.where(share > 0, np.clip(np.rint(-np.log10(share) * _STEP), 0, int(NONE) - 1), int(NONE)).astype(np.uint16)


_RESTORED = np.append(10.0 ** (np.arange(65535) / -_STEP), 0.0)


def restore(q: np.ndarray) -> np.ndarray:
    return _RESTORED[q]


class Children:
    """A level above the first: pointers of the parents, their children, the children's shares and the parents' mass for lower orders."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.ptr, self.child = EliasFano(_under(parts, "ptr")), EliasFano(_under(parts, "child"))
        self.alpha, self.gamma = parts["alpha"], parts["gamma"]

    def find(self, parents: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs, parents sorted (-1: none): the child's node (-1: none) and its quantised share."""
        node, alpha = np.full(len(parents), -1, np.int32 if self.child.n < 1 << 31 else np.int64), np.full(len(parents), NONE)
        for at in range(0, len(parents) if self.child.n else 0, _BLOCK):
            own = slice(at, at + _BLOCK)
            self._find(parents[own], words[own], node[own], alpha[own])
        return node, alpha

    def _find(self, parents: np.ndarray, words: np.ndarray, node: np.ndarray, alpha: np.ndarray) -> None:
        own = np.flatnonzero((parents >= 0) & (words >= 0))
        if not len(own):
            return
        new = np.concatenate([[True], parents[own][1:] != parents[own][:-1]])
        local, back = parents[own][new], np.cumsum(new) - 1
        begin, end = self.ptr.access(local).astype(np.int64), self.ptr.access(local + 1).astype(np.int64)
        base = np.zeros(len(local), _U64)
        some = (begin > 0) & (end > begin)
        base[some] = self.child.access(begin[some] - 1) + _U64(1)
        full = (end > begin)[back]
        own, back = own[full], back[full]
        at, ok = self.child.successor(base[back] + words[own].astype(_U64))
        ok &= at < end[back]  # a value of the next context may be equal
        node[own[ok]] = at[ok]
        alpha[own[ok]] = self.alpha[at[ok]]

    def mass(self, parents: np.ndarray) -> np.ndarray:
        """Quantised; NONE for no parent."""
        out = np.full(len(parents), NONE)
        own = parents >= 0
        out[own] = self.gamma[parents[own]]
        return out


def level(parent: np.ndarray, word: np.ndarray, counts: np.ndarray, totals: np.ndarray, discount: float, vocabulary: int) -> dict[str, np.ndarray]:
    """A level from its nodes in order (parents' places, word codes, counts) and the parents' counts."""
    n = np.bincount(parent, minlength=len(totals))
    ptr = np.concatenate([[0], np.cumsum(n)])
    last = np.where(n > 0, word[np.maximum(ptr[1:] - 1, 0)].astype(np.int64) + 1 if len(word) else 0, 0)  # a range's values end below its base plus this
    base = np.concatenate([[0], np.cumsum(last)])
    alpha, taken = np.empty(len(word), np.uint16), np.zeros(len(totals))
    for at in range(0, len(word), _BLOCK):
        own = slice(at, at + _BLOCK)
        share = (counts[own] - discount) / totals[parent[own]]
        alpha[own] = quantise(share)
        np.add.at(taken, parent[own], share)
    children = base[parent]
    children += word
    return {"alpha": alpha, "gamma": quantise(np.clip(1 - taken, 1e-12, 1))} | _named("ptr", encode(ptr, len(word) + 1)) | _named("child", encode(children, int(base[-1]) + vocabulary + 1))


def mapped(parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays laid out in a file without a name, which goes with its last map."""
    with tempfile.TemporaryFile() as f:
        f.writelines(_pieces(parts))
        f.flush()
        return unpack(np.memmap(f, np.uint8, "r"))


# --- chunks of tokens -------------------------------------------------------------------------------


#: The end of a text as a token.
END = _U64(0x5851F42D4C957F2D)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all tokens and the number of each text's: its words, lower-cased, and its end. A word's name is a 64-bit fingerprint of its bytes."""
    name, words = word_prints(texts)
    text = np.repeat(np.arange(len(texts)), words)
    out = np.full(len(name) + len(texts), END)
    out[np.arange(len(name)) + text] = name
    return out, words + 1


_CHUNK = "n long, head binary, words binary, data binary"


def _chunked(names: list[str]):
    """Rows of texts as chunks: their columns as an Arrow stream; distinct words, sorted, and how often they occur in texts that train; the tokens, frequent words having small codes, which word each code is, sizes, and which texts train."""

    def chunk(parts) -> pa.RecordBatch:
        head = pa.Table.from_batches([b.select(names) for b, *_ in parts])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, head.schema) as out:
            out.write_table(head)
        words, codes, n = np.unique(np.concatenate([t for _, t, *_ in parts]), return_inverse=True, return_counts=True)
        size, train = np.concatenate([z for *_, z, _ in parts]), np.concatenate([x for *_, x in parts])
        counts = np.bincount(codes[np.repeat(train, size).astype(bool)], minlength=len(words))
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        own = squeeze({"step": np.diff(words, prepend=_U64(0)), "counts": _small(counts)})
        data = squeeze({"codes": _small(rank[codes]), "order": _small(order), "size": _small(size), "train": train})
        return pa.RecordBatch.from_arrays([pa.array([len(codes)], pa.int64()), *[pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), own, data)]], ["n", "head", "words", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, got = [], 0
        for batch, texts in blocks(batches, "_text", 1 << 20):
            name, size = tokens(texts)
            parts.append((batch, name, size, batch.column("_train").to_numpy(zero_copy_only=False).astype(np.uint8)))
            got += len(name)
            if got >= CHUNK:
                yield chunk(parts)
                parts, got = [], 0
                trim()
        if parts:
            yield chunk(parts)

    return run


def _chunks(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...], train: Column) -> tuple[DataFrame, str]:
    """The chunks of a frame, written, and the kinds of the columns in their heads."""
    picked = docs.select(F.col(id_col), *carry, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    names = picked.columns[:-2]
    kinds = ", ".join(f"{c} {picked.schema[c].dataType.simpleString()}" for c in names)
    return written(picked.mapInArrow(_chunked(names), _CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "chunks"), kinds


#: What travels: to a range or shard (bucket), from or to a chunk; a part of the model (kind 0), an ask (1) or an answer (2); masses of spread words (3).
_ROWS = "kind int, bucket int, chunk long, blob binary, nodes array<long>, totals array<long>, word long, mass double"


def _rows(kind: int, bucket: list, chunk: list, blob: list, nodes: list | None = None, totals: list | None = None, word: list | None = None, mass: list | None = None) -> pa.RecordBatch:
    n = len(bucket)
    none = [None] * n
    cols = [pa.array([kind] * n, pa.int32()), pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()), pa.array(blob, pa.binary()), pa.array([nodes] * n, pa.list_(pa.int64())), pa.array([totals] * n, pa.list_(pa.int64())), pa.array(none if word is None else word, pa.int64()), pa.array(none if mass is None else mass, pa.float64())]
    return pa.RecordBatch.from_arrays(cols, ["kind", "bucket", "chunk", "blob", "nodes", "totals", "word", "mass"])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a sorted partition, those of a key at a time."""
    now, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):  # one by one, so that a key's blobs can go when it is done with them
            row = batch.slice(i, 1).to_pylist()[0]
            if row[key] != now and rows:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
            del row
    if rows:
        yield now, rows


# --- the first level --------------------------------------------------------------------------------


def _ask_words(ranges: int):
    """A chunk's distinct words by range of their hashes, and how often they occur in texts that train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("words").to_pylist(), strict=True):
                x = expand(raw)
                words = np.cumsum(x["step"], dtype=_U64)
                bucket = (words >> _U64(40)) * _U64(ranges) >> _U64(24)
                cut = np.searchsorted(bucket, np.arange(ranges + 1))
                some = [(i, a, b) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
                yield _rows(1, [i for i, _, _ in some], [chunk] * len(some), [squeeze({"step": np.diff(words[a:b], prepend=_U64(0)), "counts": _small(x["counts"][a:b])}) for _, a, b in some])

    return run


def _class(counts: np.ndarray) -> np.ndarray:
    """Bits of the counts; ids go from frequent classes to rare ones."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def _serve_words(ranges: int, build: bool):
    """The first level of each range, made of the asks or given, and for each ask the words' counts (0: unknown) and places in their class within the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _runs(batches, "bucket"):
            asks = [(r["chunk"], expand(r["blob"])) for r in rows if r["kind"] == 1]
            lo, hi = (-(-(x << 24) // ranges) << 40 for x in (bucket, bucket + 1))
            given = [r["blob"] for r in rows if r["kind"] == 0]
            if build:
                names, back = np.unique(np.concatenate([np.cumsum(x["step"], dtype=_U64) for _, x in asks]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([x["counts"] for _, x in asks]), len(names)).astype(np.int64)
                names, counts = names[counts > 0], counts[counts > 0]
                kind = _class(counts)
                order, sizes = np.argsort(kind, kind="stable"), np.bincount(kind, minlength=64)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                parts = {"counts": _small(counts), "place": _small(place)} | _named("hash", encode(names - _U64(lo), min(hi, 1 << 64) - lo))
                yield _rows(0, [bucket], [None], [squeeze(parts)], sizes.tolist(), [int(counts.sum())])
            elif given:
                parts = expand(given[0])
            else:
                parts = {"counts": np.zeros(0, np.uint8), "place": np.zeros(0, np.uint8)} | _named("hash", encode(np.zeros(0, _U64), min(hi, 1 << 64) - lo))
            parts = mapped(parts)
            hashes = EliasFano(_under(parts, "hash"))
            for chunk, x in asks:
                at, ok = hashes.successor(np.cumsum(x["step"], dtype=_U64) - _U64(lo))
                place, counts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                place[ok], counts[ok] = parts["place"][at[ok]], parts["counts"][at[ok]]
                yield _rows(2, [bucket], [chunk], [squeeze({"place": _small(place), "counts": _small(counts)})])

    return run


# --- n-grams ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Known:
    """What every task has to know of the first level: ranges, the ids before each class and range, all words, all tokens; and shards."""

    ranges: int
    before: np.ndarray
    vocabulary: int
    total: int
    shards: int
    order: int

    def spread(self, counts: np.ndarray) -> np.ndarray:
        """Over how many shards the children of words of these counts are spread: a word's fair share of shards, four times as fine, and one."""
        return np.minimum(1 + counts * 4 * self.shards // max(self.total, 1), self.shards)


class Grams:
    """The distinct n-grams of a chunk as a trie of its own, in the order in which shards are asked."""

    def __init__(self, x: dict[str, np.ndarray], ids: np.ndarray, counts: np.ndarray, known: Known):
        """ids and counts: of the chunk's words by code (-1 and 0: unknown)."""
        codes, size = x["codes"].astype(np.int32), x["size"].astype(np.int64)
        within = np.arange(len(codes), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
        trains = np.repeat(x["train"], size).astype(bool)
        word = np.where((ids >= 0)[codes], codes, np.int32(-1))
        # Roots: pairs of shard and first word; a word that is not spread has one, even if nothing known follows it.
        spread = known.spread(counts)
        home = (mix64(ids.astype(_U64)) >> _U64(32)) * _U64(known.shards) >> _U64(32)
        at = np.flatnonzero(within >= 1)
        at = at[word[at - 1] >= 0]
        ahead = np.unique(word[at - 1])
        at = at[word[at] >= 0]
        u, v, back = distinct(word[at - 1], word[at])
        shard = ((home[u] + mix64(ids[v].astype(_U64) + _U64(1)) % spread[u].astype(_U64)) % _U64(known.shards)).astype(np.int64)
        one = ahead[spread[ahead] == 1]
        first = shard << 32 | u
        roots = np.unique(np.concatenate([first, home[one].astype(np.int64) << 32 | one]))
        self.root_shard, self.root = roots >> 32, roots & 0xFFFFFFFF
        self.root_of = np.full(len(ids), -1, np.int64)  # of words with one root
        single = spread[self.root] == 1
        self.root_of[self.root[single]] = np.flatnonzero(single)
        parent = np.searchsorted(roots, first)
        del shard, first, u
        self.parents, self.words, self.counts, self.gram = [], [], [], []
        last = word
        for n in range(2, known.order + 1):
            if n > 2:
                at = np.flatnonzero((within >= n - 1) & (word >= 0))
                at = at[last[at - 1] >= 0]
                parent, v, back = distinct(last[at - 1], word[at])
            else:
                order = np.argsort(parent, kind="stable")
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order), dtype=np.int32)
                parent, v, back = parent[order], v[order], rank[back]
                del order, rank
            last = np.full(len(codes), -1, np.int32)  # the n-gram that ends at each token
            last[at] = back
            self.parents.append(parent.astype(np.int32))
            self.words.append(v.astype(np.int32))
            self.counts.append(np.bincount(back[trains[at]], minlength=len(parent)))
            self.gram.append(last)
        self.word, self.within = word, within

    def asks(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """For each shard its part of the trie: its words' ids, roots with their counts, and for each level the numbers of children, their words and counts."""
        shards, first = np.unique(self.root_shard, return_index=True)
        cuts = [np.append(first, len(self.root))]
        for p in self.parents:
            cuts.append(np.searchsorted(p, cuts[-1]))
        for i, shard in enumerate(shards.tolist()):
            own = self.root[cuts[0][i] : cuts[0][i + 1]]
            words = [w[cuts[k + 1][i] : cuts[k + 1][i + 1]] for k, w in enumerate(self.words)]
            used, code = np.unique(ids[np.concatenate([own, *words])], return_inverse=True)  # frequent words have small codes here too
            code = np.split(code, np.cumsum([len(own), *map(len, words)])[:-1])
            out = {"step": _small(np.diff(used, prepend=0)), "root": _small(code[0]), "total": _small(counts[own])}
            for k, (p, c) in enumerate(zip(self.parents, self.counts, strict=True)):
                (a, b), (e, f) = cuts[k][i : i + 2], cuts[k + 1][i : i + 2]
                out |= {f"n{k}": _small(np.bincount(p[e:f] - a, minlength=b - a)), f"w{k}": _small(code[k + 1]), f"c{k}": _small(c[e:f])}
            yield shard, squeeze(out)


def _words_of(x: dict[str, np.ndarray], answers: list[dict], known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of a chunk's words, by code, from the answers of the ranges, which are in the order of the words."""
    ids, counts = [], []
    for r in answers:
        got = expand(r["blob"])
        counts.append(got["counts"].astype(np.int64))
        ids.append(np.where(counts[-1] > 0, known.before[_class(counts[-1]), r["bucket"]] + got["place"].astype(np.int64), -1))
    order = x["order"].astype(np.int64)
    return np.concatenate(ids)[order], np.concatenate(counts)[order]


def _ask_grams(known: Known):
    """Over (chunk, its answers of the first level), sorted: the asks to the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _runs(batches, "chunk"):
            x = expand(rows[0]["blob"])
            ids, counts = _words_of(x, rows[1:], known)
            for shard, blob in Grams(x, ids, counts, known).asks(ids, counts):
                yield _rows(1, [shard], [chunk], [blob])
            del x, ids, counts, rows
            trim()

    return run


class Asked:
    """The asks of a shard together: their distinct words, roots and n-grams, and where each ask's are among them."""

    def __init__(self, asks: list[dict[str, np.ndarray]], order: int):
        """The asks are emptied. Roots, in order, are cut into slices of about _BLOCK n-grams, which are sorted one after the other."""
        steps = np.concatenate([np.cumsum(x["step"], dtype=np.int64) for x in asks])
        _, self.words, place = distinct(np.zeros(len(steps), np.uint8), steps)
        start = np.cumsum([0] + [len(x.pop("step")) for x in asks])
        del steps

        def code(name: str) -> np.ndarray:
            out, at = np.empty(sum(len(x[name]) for x in asks), np.int32), 0
            for a, x in zip(start.tolist(), asks, strict=False):
                own = x.pop(name)
                out[at : at + len(own)] = place[a:][own]
                at += len(own)
            return out

        self.sizes = [np.array([len(x["root"]) for x in asks]), *[np.array([len(x[f"w{k}"]) for x in asks]) for k in range(order - 1)]]
        root = code("root")  # as places among the words
        _, self.root, up = distinct(np.zeros(len(root), np.uint8), root)
        self.total = np.zeros(len(self.root), np.int64)
        self.total[up] = np.concatenate([x.pop("total") for x in asks])
        under, at = np.zeros(len(self.root), np.int64), 0  # n-grams under each root
        for x, n in zip(asks, self.sizes[0].tolist(), strict=True):
            own = up[at : at + n]
            at += n
            for k in range(order - 1):
                own = np.repeat(own, x[f"n{k}"])
                np.add.at(under, own, 1)
        slice_of = _small((np.cumsum(under) - under) // _BLOCK)
        slices, many, words, counts = [slice_of[up]], [], [], []
        for k in range(order - 1):
            many.append(np.concatenate([x.pop(f"n{k}") for x in asks]))
            slices.append(np.repeat(slices[-1], many[-1]))
            words.append(code(f"w{k}"))
            counts.append(np.concatenate([x.pop(f"c{k}") for x in asks]))
        self.back = [up, *[np.empty(len(w), up.dtype) for w in words]]
        found: list[list] = [[] for _ in words]
        done = [0] * len(words)
        for turn in np.unique(slice_of).tolist():
            at = np.flatnonzero(slices[0] == turn)
            for k in range(order - 1):
                above = np.repeat(self.back[k][at], many[k][at])
                at = np.flatnonzero(slices[k + 1] == turn)
                parent, word, back = distinct(above, words[k][at])
                found[k].append((parent.astype(up.dtype), word.astype(np.int32), _small(np.bincount(back, counts[k][at], len(parent)).astype(np.int64))))
                self.back[k + 1][at] = back + done[k]
                done[k] += len(parent)
        del slices, many, words, counts
        self.parent, self.word, self.counts = [], [], []
        for own in found:
            for out, x in zip((self.parent, self.word, self.counts), zip(*own, strict=True), strict=True):
                out.append(np.concatenate(x))
            own.clear()

    def grow(self, least: int, discount: float) -> tuple[dict[str, np.ndarray], list[int], list[int], np.ndarray]:
        """The shard: its arrays, nodes and sums of counts by level, and the mass of each root's children."""
        roots = self.words[self.root]
        out = _named("roots", encode(roots, int(roots[-1]) + 1)) | _named("words", encode(self.words, int(self.words[-1]) + 1))
        nodes, sums, mass, totals = [], [], np.zeros(len(roots)), self.total
        node = np.arange(len(roots), dtype=self.back[0].dtype)  # of the level before, kept ones numbered
        for k, (parent, word, counts) in enumerate(zip(self.parent, self.word, self.counts, strict=True)):
            kept = (counts >= max(least, 1)) & (node[parent] >= 0)
            parent, word, c = node[parent[kept]], word[kept], counts[kept]
            out |= _named(f"level{k}", level(parent, word, c, totals, discount, len(self.words)))
            if not k:
                mass = np.bincount(parent, (c - discount) / totals[parent], len(roots))
            nodes.append(len(c))
            sums.append(int(c.sum()))
            node, totals = np.where(kept, np.cumsum(kept, dtype=node.dtype) - node.dtype.type(1), node.dtype.type(-1)), c
        return out, nodes, sums, mass

    def answers(self, parts: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        """For each ask, in order, quantised: the mass for lower orders of each root and n-gram that has a next level, the share of each n-gram. All distinct ones are looked up in the shard's arrays at once."""
        at, ok = EliasFano(_under(parts, "words")).successor(self.words.astype(_U64))
        code = np.where(ok, at, -1).astype(np.int32)
        at, ok = EliasFano(_under(parts, "roots")).successor(self.words[self.root].astype(_U64))
        node = np.where(ok, at, -1)
        out = {}
        for k, (parent, word) in enumerate(zip(self.parent, self.word, strict=True)):
            own = Children(_under(parts, f"level{k}"))
            out[f"g{k}"] = np.split(own.mass(node)[self.back[k]], np.cumsum(self.sizes[k])[:-1])
            node, alpha = own.find(node[parent], code[word])
            out[f"a{k}"] = np.split(alpha[self.back[k + 1]], np.cumsum(self.sizes[k + 1])[:-1])
        for i in range(len(self.sizes[0])):
            yield {k: v[i] for k, v in out.items()}


def _serve_grams(known: Known, least: int, discount: float, build: bool, keep: bool, answer: bool):
    """The shards, made of the asks (and given out, if they are to be kept) or given, and the answers to the asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _runs(batches, "bucket"):
            chunks = [r["chunk"] for r in rows if r["kind"] == 1]
            if not chunks:
                continue
            given = [r["blob"] for r in rows if r["kind"] == 0]
            asks = [r["blob"] for r in rows if r["kind"] == 1]
            rows.clear()
            asked = Asked([expand(x) for x in asks], known.order)
            del asks
            if build:
                parts, nodes, sums, mass = asked.grow(least, discount)
                yield _rows(0, [shard], [None], [squeeze(parts) if keep else None], nodes, sums)
                wide = known.spread(asked.total) > 1
                if wide.any():
                    n = int(wide.sum())
                    yield _rows(3, [shard] * n, [None] * n, [None] * n, None, None, asked.words[asked.root[wide]].tolist(), mass[wide].tolist())
            else:
                parts = expand(given[0]) if given else None
            if answer:
                none = lambda: ({f"g{k}": np.full(asked.sizes[k][i], NONE) for k in range(known.order - 1)} | {f"a{k}": np.full(asked.sizes[k + 1][i], NONE) for k in range(known.order - 1)} for i in range(len(chunks)))  # noqa: B023, E731
                for chunk, got in zip(chunks, asked.answers(mapped(parts)) if parts else none(), strict=True):
                    yield _rows(2, [shard], [chunk], [squeeze(got)])
            del asked, parts
            trim()

    return run


def _finish(known: Known, wide, names: list[str]):
    """Over (chunk, answers of the first level, answers of the shards), sorted: the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masses = wide.value
        for _, rows in _runs(batches, "chunk"):
            head = pa.ipc.open_stream(rows[0]["head"]).read_all().combine_chunks()
            x = expand(rows[0]["blob"])
            ids, counts = _words_of(x, [r for r in rows if r["kind"] == 1], known)
            grams = Grams(x, ids, counts, known)
            got = [expand(r["blob"]) for r in rows if r["kind"] == 2]
            rows.clear()
            of = lambda name: np.concatenate([g[name] for g in got] or [np.zeros(0, np.uint16)])  # noqa: E731, B023
            codes, size = x["codes"].astype(np.int64), x["size"].astype(np.int64)
            prob = ((counts + 0.5) / (known.total + 0.5 * (known.vocabulary + 1)))[codes]
            p = prob.copy()
            context, some = np.zeros(len(codes), bool), grams.word >= 0
            context[1:] = some[:-1]
            at = np.flatnonzero(context & (grams.within >= 1))
            root = grams.root_of[grams.word[at - 1]]
            gamma = np.ones(len(at))
            if known.order > 1 and len(at):
                one = root >= 0
                gamma[one] = restore(of("g0")[root[one]])
                gamma[~one] = [masses.get(int(i), 1.0) for i in ids[grams.word[at - 1][~one]]]
                p[at] *= gamma
            for k, gram in enumerate(grams.gram):
                alpha = restore(of(f"a{k}"))
                at = np.flatnonzero(gram >= 0)
                p[at] += alpha[gram[at]]
                if k + 1 < len(grams.gram):  # the context of the next level: n-grams that the model has
                    mass = of(f"g{k + 1}")
                    at = np.flatnonzero((grams.within >= k + 2) & np.concatenate([[False], gram[:-1] >= 0]))
                    at = at[mass[gram[at - 1]] != NONE]
                    p[at] *= restore(mass[gram[at - 1]])
            start = np.cumsum(size) - size
            base, score = np.add.reduceat(np.log10(prob), start), np.add.reduceat(np.log10(p), start)
            n_known = np.add.reduceat(some.astype(np.int64), start)
            cols = [head.column(c).combine_chunks() if head.num_rows else head.column(c) for c in names]
            cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
            del grams, got, x, p, prob, codes
            trim()
            yield pa.RecordBatch.from_arrays([*cols, pa.array(size), pa.array(n_known), pa.array(np.full(len(size), known.total, np.int64)), pa.array(base), pa.array(score)], [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


# --- the operator -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """The trie as written tables: ranges of words and shards (rows of kind 0), the masses of spread words, nodes and sums of counts by level."""

    known: Known
    words: DataFrame
    shards: DataFrame
    wide: dict[int, float]
    nodes: list[int]
    totals: list[int]


def _dealt(rows: DataFrame, parts: int, key: str, *more: str) -> DataFrame:
    return rows.repartition(parts, key).sortWithinPartitions(key, *more)


def _run(chunks: DataFrame, model: Model | None, keep: bool, answer: bool, order: int, least: int, discount: float) -> tuple[Model, DataFrame, DataFrame]:
    """Words first, then n-grams: the model (made of the chunks if none is given; its shards only if they are to be kept) and the written answers."""
    spark, build = chunks.sparkSession, model is None
    parts = shuffle_parts(spark)
    ranges = parts if build else model.known.ranges
    asks = chunks.select("chunk", "words").mapInArrow(_ask_words(ranges), _ROWS)
    words = written(_dealt(asks if build else asks.unionByName(model.words), ranges, "bucket", "kind", "chunk").mapInArrow(_serve_words(ranges, build), _ROWS), "words")
    del asks
    release(spark)
    if build:
        sizes = np.zeros((64, ranges), np.int64)
        total = 0
        for r in words.where("kind = 0").select("bucket", "nodes", "totals").collect():  # a row a range
            sizes[:, r[0]] = r[1]
            total += r[2][0]
        along = sizes[::-1].ravel()  # frequent classes first
        before = (np.cumsum(along) - along).reshape(sizes.shape)[::-1]
        tokens_in = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        known = Known(ranges, before, int(sizes.sum()), total, parts * max(1, -(-tokens_in // (parts * SHARD))), order)
    else:
        known = model.known
    first = words.where("kind = 2").select("chunk", F.lit(1).alias("kind"), "bucket", "blob")
    told = _dealt(chunks.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.col("data").alias("blob")).unionByName(first), parts, "chunk", "kind", "bucket")
    asks = told.mapInArrow(_ask_grams(known), _ROWS)
    served = written(_dealt(asks if build else asks.unionByName(model.shards), known.shards, "bucket", "kind", "chunk").mapInArrow(_serve_grams(known, least, discount, build, keep, answer), _ROWS), "shards")
    del asks, told
    release(spark)
    if build:
        wide = {r[0]: max(1 - r[1], 1e-12) for r in served.where("kind = 3").groupBy("word").agg(F.sum("mass")).collect()}  # 4 * shards words at most
        n = [x or 0 for x in served.where("kind = 0").select(*[F.sum(F.coalesce(F.col(c)[k], F.lit(0))) for c in ("nodes", "totals") for k in range(order - 1)]).first()]
        model = Model(known, words.where("kind = 0"), served.where("kind = 0"), wide, [known.vocabulary, *n[: order - 1]], [known.total, *n[order - 1 :]])
    return model, words, served


def _scores(chunks: DataFrame, kinds: str, model: Model, words: DataFrame, served: DataFrame) -> DataFrame:
    spark = chunks.sparkSession
    names = [k.split(" ", 1)[0] for k in kinds.split(", ")]
    state = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.col("data").alias("blob"), "head")
    answers = words.where("kind = 2").withColumn("kind", F.lit(1)).unionByName(served.where("kind = 2"))
    rows = state.unionByName(answers.select("chunk", "kind", "bucket", "blob", F.lit(None).cast("binary").alias("head")))
    wide = spark.sparkContext.broadcast(model.wide)  # 4 * shards words at most
    release(spark)  # now that later queries have run, the shuffles of the asks go
    return _dealt(rows, shuffle_parts(spark), "chunk", "kind", "bucket").mapInArrow(_finish(model.known, wide, names), f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train(texts: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, discount: float = DISCOUNT) -> Model:
    """The model of all rows of a one-column frame ``text``. Null texts are their end alone; without rows it is empty."""
    steady(texts.sparkSession)
    chunks, _ = _chunks(texts.select(F.lit(0).alias("_id"), F.col(texts.columns[0]).alias("text")), "_id", "text", (), F.lit(True))
    model, _, _ = _run(chunks, None, True, False, order, min_count, discount)
    forget(chunks)
    release(texts.sparkSession)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: id, the carried columns, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text and its end).

    ``score`` is that of the interpolated, quantised model. Null and empty texts are their end alone; repeated
    rows get the same answer; a very long text is a chunk of its own; an empty table has no rows; columns not named are not read.
    """
    steady(docs.sparkSession)
    chunks, kinds = _chunks(docs, id_col, text_col, carry, F.lit(False))
    _, words, served = _run(chunks, model, False, True, model.known.order, 1, 0.0)
    return _scores(chunks, kinds, model, words, served)


def train_and_score(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), order: int = ORDER, min_count: int = MIN_COUNT, discount: float = DISCOUNT) -> DataFrame:
    """``train`` on the rows for which ``trains`` holds and ``score`` of all rows, in one pass: every n-gram travels once."""
    steady(docs.sparkSession)
    chunks, kinds = _chunks(docs, id_col, text_col, carry, trains)
    model, words, served = _run(chunks, None, False, True, order, min_count, discount)
    return _scores(chunks, kinds, model, words, served)


def held_out(id_col, folds: int = FOLDS, fold: int = HELD_OUT):
    """Documents to be scored only. A null id trains."""
    return F.coalesce(crc_mod(id_col, folds) == fold, F.lit(False))
