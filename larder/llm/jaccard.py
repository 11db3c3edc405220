"""Exact n-gram Jaccard join by token-combination prefixes, and the components its links make.

Equal shingle sets form a class and only one row of each class is indexed. Tokens are ordered rare
ones first (by 64-bit name), frequent ones last. A set's prefix is extended by k - 1 tokens, so that
two similar sets share k tokens of their prefixes. Rare tokens of the prefix are indexed one by
one. If all shared tokens are frequent, k of them fall into k - 1 bins, so two fall into one bin:
frequent tokens are indexed as pairs within bins. Whatever shares an index key is verified on the
whole sets, first against one member of its group, then, for groups whose members are not yet in one
component, against another; last, such groups are cut into units of bounded size, in which members of
lighter components are compared with members of heavier ones by parity bitmaps, which can only rule
pairs out: first each with the nearest one. Members to which the bitmaps still allow a partner are regrouped
by the components that such pairs connect, a row a member however many its pairs, compared by finer
bitmaps, regrouped alike, and last compared as whole sets where those bitmaps allow it. So groups of near copies
cost a row a member and unit, pairs are never laid out as rows, and no link between different components is left unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST, blocks, by_bucket, document, forget, mix64, release, shuffle_parts, steady, written
from .prints import word_prints

WORDS = 5
PERCENT = 80
#: A token in more class representatives than this is frequent; the bound doubles until no more than MAX_FREQUENT names are.
FREQUENT = 2
MAX_FREQUENT = 1 << 22
#: Frequent prefix tokens that share a bin, about.
BIN = 8
BROADCAST_ROWS = 300_000
#: Further rounds in which groups with several components try one member against the others, before the search in units.
STAR_ROUNDS = 1
#: Queries and targets of a unit of that search, and their tokens, about.
UNIT_ROWS, UNIT_TOKENS = 2048, 1 << 20
#: Bits a token of the bitmaps that all members get, and of those for members that still have a partner.
COARSE, FINE = 2, 8
_FLUSH = 1_000_000
#: Index entries of a bucket that are looked at together, and pairs.
_PASS, _PAIRS = 500_000, 200_000


def shingle_sets(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit names of each text's distinct shingles of lower-cased words."""
    word, sizes = word_prints(texts)
    h = np.zeros(max(len(word) - n + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + word[i : i + len(h)] + np.uint64(i))
    out, at = [], 0
    for size in sizes.tolist():
        if size >= n:
            out.append(np.unique(h[at : at + size - n + 1]))
        elif size:
            out.append(np.array([xxhash.xxh3_64_intdigest(word[at : at + size].tobytes(), seed=size)], np.uint64))
        else:
            out.append(h[:0])
        at += size
    return out


def _key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _binary16(raw: bytes, n: int) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), n, [None, pa.py_buffer(raw)]).cast(pa.binary())


def _members(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            sets = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), pa.array([_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["doc", "mark", "k", "n"])

    return run


def _squeeze(names: np.ndarray) -> bytes:
    """Sorted 32-bit names: the first and 16-bit steps, or plain where a step is longer."""
    step = np.diff(names)
    if len(names) and (step < 1 << 16).all():
        return b"\1" + names[:1].tobytes() + step.astype(np.uint16).tobytes()
    return b"\0" + names.tobytes()


def _unsqueeze(blob: bytes) -> np.ndarray:
    if blob[0]:
        first = np.frombuffer(blob, np.uint32, 1, 1)
        return np.concatenate([first, first + np.cumsum(np.frombuffer(blob, np.uint16, -1, 5), dtype=np.uint32)])
    return np.frombuffer(blob, np.uint32, -1, 1)


def _names(words: int, buckets: int):
    """Every token of every set, as sorted 32-bit names in blobs by bucket."""

    def flush(parts):
        top = np.sort((np.concatenate(parts) >> np.uint64(32)).astype(np.uint32))
        cut = np.concatenate([[0], np.searchsorted(top, np.array([(i << 32) // buckets for i in range(1, buckets)], np.uint64)), [len(top)]])
        some = [(i, a, b) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in some], pa.int32()), pa.array([_squeeze(top[a:b]) for _, a, b in some], pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for _, texts in blocks(batches):
            for s in shingle_sets(texts, words):
                parts.append(s)
                size += len(s)
            if size > _FLUSH:
                yield flush(parts)
                parts, size = [], 0
        if size:
            yield flush(parts)

    return run


def _counted(least: int):
    """Names found more than ``least`` times with their counts, and how many of them there are by the bits of the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unsqueeze(b) for batch in batches for b in batch.column("blob").to_pylist()]
        if parts:
            names = np.concatenate(parts)
            del parts
            names.sort()
            often = names[least:] == names[: len(names) - least]  # the name goes on for ``least`` places
            first = np.flatnonzero(often[1:] & (names[1 : len(often)] != names[: max(len(often) - 1, 0)])) + 1
            if len(often) and often[0]:
                first = np.concatenate([[0], first])
            names, counts = names[first], np.searchsorted(names, names[first], side="right") - first
            bits = np.bincount(np.frexp((counts - 1).astype(float))[1], minlength=64)
            yield pa.RecordBatch.from_arrays([pa.array([names.tobytes()], pa.binary()), pa.array([counts.astype(np.uint32).tobytes()], pa.binary()), pa.array([bits.tolist()], pa.list_(pa.int64()))], ["names", "counts", "bits"])

    return run


def _more_than(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.frombuffer(n, np.uint32)[np.frombuffer(c, np.uint32) > least].tobytes() for n, c in zip(batch.column("names").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["names"])

    return run


def frequent_names(counted: DataFrame) -> np.ndarray:
    """Sorted names of the frequent class: MAX_FREQUENT at most, as the bound on their counts doubles until that holds."""
    by_bits = np.zeros(64, np.int64)
    for r in counted.select("bits").toLocalIterator():
        by_bits += np.array(r[0])
    bits = next(b for b in range(1, 64) if by_bits[b + 1 :].sum() <= MAX_FREQUENT)  # counts over 2^b have counts - 1 of more bits
    parts = [np.frombuffer(r[0], np.uint32) for r in counted.select("names", "counts").mapInArrow(_more_than(max(FREQUENT, 1 << bits)), "names binary").toLocalIterator()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


def need(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n must share with any similar set."""
    return -(-percent * n // 100)


def bins_of(level: int, percent: int = PERCENT) -> int:
    """Bins for pairs of sets whose smaller one has a size of ``level`` bits."""
    least = 1 << (level - 1)
    return max(1, round(1.5 * (least - need(least, percent) + 1) / BIN))


def index_keys(s: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set is indexed, and for each how many of the set's tokens can be shared by a pair whose first common key it is.

    Nothing before a rare token is shared if it is the first one shared; and a pair that shares no rare
    token shares frequent ones only.
    """
    n = len(s)
    if n < 2:  # a set of one token is similar to its equals alone, which are its class
        return s[:0], np.zeros(0, np.int64)
    name = (s >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(frequent, name), max(len(frequent) - 1, 0))
    often = frequent[at] == name if len(frequent) else np.zeros(n, bool)
    ordered = np.concatenate([s[~often], s[often]])
    rare = n - int(often.sum())
    levels = {n.bit_length(), max(need(n, percent), 1).bit_length()}
    keys = []
    longest = 0
    for level in levels:
        bins = bins_of(level, percent)
        prefix = min(n, n - need(n, percent) + bins + 1)
        longest = max(longest, prefix)
        own = ordered[rare:prefix]
        if len(own) > 1:
            where = (mix64(own) % np.uint64(bins)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            own, where = own[order], where[order]
            for gap in range(1, len(own)):
                same = where[gap:] == where[:-gap]
                if not same.any():
                    break
                a, b = own[:-gap][same], own[gap:][same]
                with np.errstate(over="ignore"):
                    keys.append(mix64(mix64(a + np.uint64(level)) * np.uint64(0xD6E8FEB86659FD93) + b))
    single = min(rare, longest)
    rest = np.concatenate([np.full(sum(len(k) for k in keys), n - rare), n - np.arange(single)])
    keys, first = np.unique(np.concatenate([*keys, ordered[:single]]), return_index=True)
    return keys, rest[first]


def _index(words: int, buckets: int, frequent, percent: int):
    """Index entries in blobs by bucket: keys, places in the blob's table of sets, the table's names and sizes."""

    def flush(keys, rests, sets):
        which = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])
        flat = np.concatenate(keys)
        bucket = ((flat >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rest = np.concatenate(rests)[order]
        rest = rest.astype(np.uint16 if rest.max() < 1 << 16 else np.uint32)
        flat, which = flat[order].astype(np.uint32), which[order]  # within a bucket the lower half tells keys apart well enough: sets are compared whole later
        names = np.frombuffer(b"".join(k for k, _ in sets), np.uint8).reshape(-1, 16)
        sizes = np.array([n for _, n in sets], np.uint32)
        out: list[list] = [[], [], [], [], [], []]
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if a < b:
                used, place = np.unique(which[a:b], return_inverse=True)
                for col, x in zip(out, (i, flat[a:b].tobytes(), place.astype(np.uint16).tobytes(), rest[a:b].tobytes(), names[used].tobytes(), sizes[used].tobytes()), strict=True):
                    col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], ["bucket", "keys", "places", "rests", "names", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        keys, rests, sets, size = [], [], [], 0
        for _, texts in blocks(batches):
            for s in shingle_sets(texts, words):
                k, rest = index_keys(s, often, percent)
                if len(k):
                    keys.append(k)
                    rests.append(rest)
                    sets.append((_key(s), len(s)))
                    size += len(k)
                if len(sets) == 1 << 16:  # places are 16-bit
                    yield flush(keys, rests, sets)
                    keys, rests, sets, size = [], [], [], 0
            if size > _FLUSH:
                yield flush(keys, rests, sets)
                keys, rests, sets, size = [], [], [], 0
        if size:
            yield flush(keys, rests, sets)

    return run


def _groups(percent: int):
    return lambda batches: _group(batches, percent)


def _group(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Groups of two or more sets under one key, equal groups once: group, set, size, tokens that can be shared, and the same of the hub (the group's least set)."""
    keys, places, rests, names, sizes, base = [], [], [], [], [], 0
    for batch in batches:
        for k, p, r, nm, sz in zip(*[batch.column(c).to_pylist() for c in ("keys", "places", "rests", "names", "sizes")], strict=True):
            keys.append(np.frombuffer(k, np.uint32))
            rests.append(np.frombuffer(r, np.uint16 if len(r) < len(k) else np.uint32).astype(np.uint32))
            places.append(np.frombuffer(p, np.uint16).astype(np.uint32) + np.uint32(base))
            names.append(nm)
            sizes.append(np.frombuffer(sz, np.uint32))
            base += len(sizes[-1])
    if not keys:
        return
    table = np.frombuffer(b"".join(names), ">u8").reshape(-1, 2)
    size = np.concatenate(sizes).astype(np.int64)
    rank_of = np.lexsort((table[:, 1], table[:, 0]))
    same = np.ones(len(rank_of), bool)
    ordered = table[rank_of]
    same[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    rank = np.empty(len(rank_of), np.uint32)
    rank[rank_of] = np.cumsum(same) - 1  # equal sets from several blobs get one number
    table, size = ordered[same], size[rank_of][same]
    every_key, every_place, every_rest = np.concatenate(keys), rank[np.concatenate(places)], np.concatenate(rests)
    del keys, places, rests, names, rank, rank_of, ordered
    passes = -(-len(every_key) // _PASS)
    turn_of = every_key % np.uint32(passes)
    seen = np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        t = table.astype(np.uint64)
        print_of = mix64(t[:, 0] + np.uint64(1)) + mix64(t[:, 1])
    for turn in range(passes):
        own = turn_of == turn
        key, place, rest = every_key[own], every_place[own].astype(np.int64), every_rest[own].astype(np.int64)
        # A set whose shared tokens cannot suffice even for its smallest partner has no use for the key.
        use = (100 + percent) * rest >= percent * (size[place] + -(-percent * size[place] // 100))
        key, place, rest = key[use], place[use], rest[use]
        # Nor has one without another of a size that allows a link: look at the neighbours by size within the key.
        order = np.lexsort((size[place], key))
        key, place, rest = key[order], place[order], rest[order]
        near = (key[1:] == key[:-1]) & (100 * size[place[:-1]] >= percent * size[place[1:]]) & (place[1:] != place[:-1])
        keep = np.zeros(len(key), bool)
        keep[1:] |= near
        keep[:-1] |= near
        key, place, rest = key[keep], place[keep], rest[keep]
        order = np.lexsort((-rest, place, key))
        key, place, rest = key[order], place[order], rest[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
        key, place, rest = key[fresh], place[fresh], rest[fresh]
        if not len(key):
            continue
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(start, len(key)))
        with np.errstate(over="ignore"):
            gid = mix64(np.add.reduceat(mix64(print_of[place] + rest.astype(np.uint64)), start) + count.astype(np.uint64))
        many = np.flatnonzero(count > 1)
        _, one = np.unique(gid[many], return_index=True)
        many = many[np.sort(one)]
        many = many[~np.isin(gid[many], seen)]
        seen = np.concatenate([seen, gid[many]])
        for at in range(0, len(many), 20_000):
            own = many[at : at + 20_000]
            n = count[own]
            idx = np.repeat(start[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, hub_at = place[idx], np.repeat(start[own], n)  # places are ranks, so the first is the least
            hub = place[hub_at]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(gid[own], n).view(np.int64)), _binary16(table[who].tobytes(), len(who)), pa.array(size[who]), pa.array(rest[idx]), _binary16(table[hub].tobytes(), len(hub)), pa.array(size[hub]), pa.array(rest[hub_at])], ["gid", "k", "n", "m", "hub", "hub_n", "hub_m"])


def _tokens(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([s.tobytes() for s in shingle_sets(texts, words)], pa.binary())], ["k", "tokens"])

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            last, left = None, None
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                if x is not last:
                    last, left = x, np.frombuffer(x, np.uint64)
                ok.append(_alike(left, np.frombuffer(y, np.uint64), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """Each node of the edges (a, b) with the least node it is connected to: (k, label). Large-star and small-star rounds, cut at each."""
    own = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = written(small, "edges")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(own)
        own = new
        if now == state:
            break
        state = now
    release(edges.sparkSession)
    return own.select(F.col("u").alias("k"), F.col("v").alias("label"))


def similar(n, m, other_n, other_m, percent: int):
    """Sizes and shared tokens that a link allows."""
    return (F.lit(100) * F.least(n, other_n) >= F.lit(percent) * F.greatest(n, other_n)) & (F.lit(100 + percent) * F.least(m, other_m) >= F.lit(percent) * (n + other_n))


#: More shared tokens than any set has: no bound.
_WHOLE = 1 << 40
_GROUP = "gid long, k binary, n long, m long"


def _bitmaps(times: int):
    """Parity bitmaps of sets, a power of two of at least ``times`` as many bits as tokens: the bits in which two differ are no more than the tokens that only one set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("tokens").to_pylist():
                s = np.frombuffer(raw, np.uint64)
                size = 1 << max(6, (times * len(s) - 1).bit_length())
                odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
                out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.binary())], ["k", "bits"])

    return run


def _units(groups: DataFrame, info: DataFrame) -> DataFrame:
    """Members of groups, dealt to units of bounded size: gid, qb, tb (the unit), k, n, m, label, weight, query, target, bits.

    A small group is a unit. The queries and targets of a large one (here every member is both) are cut
    into blocks by hash, and every pair of blocks is a unit.
    """
    size = F.greatest(F.col("rows") / F.lit(UNIT_ROWS), F.col("tokens") / F.lit(UNIT_TOKENS))
    large = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens")).where(size > 1).select("gid", F.ceil(size).cast("int").alias("cuts"))
    large = written(large, "large")
    unit = lambda qb, tb, query, target: F.struct(qb.alias("qb"), tb.alias("tb"), query.alias("query"), target.alias("target"))
    yes, no = F.lit(True), F.lit(False)
    block = F.pmod(F.xxhash64("k"), F.col("cuts").cast("long")).cast("int")
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    at = F.concat(F.transform(every, lambda qb: unit(qb, block, no, yes)), F.transform(every, lambda tb: unit(block, tb, yes, no)))
    kinds = [F.col("gid"), F.col("at.qb"), F.col("at.tb"), F.col("k"), F.col("n"), F.col("m"), F.col("label"), F.col("weight"), F.col("at.query"), F.col("at.target"), F.col("bits")]
    whole = groups.join(large, "gid", "left_anti").join(info, "k").withColumn("at", unit(F.lit(0), F.lit(0), yes, yes)).select(*kinds)
    cut = groups.join(large, "gid").join(info, "k").withColumn("at", F.explode(at)).select(*kinds)
    return whole.unionByName(cut)


def _mixed(groups: DataFrame, labels: DataFrame, *hub: Column) -> DataFrame:
    """Members (gid, k, n, m, label) of the groups that have several components, written; and what an aggregate says of each group."""
    placed = groups.select("gid", "k", "n", "m").join(labels, "k", "left").select("gid", "k", "n", "m", F.coalesce("label", "k").alias("label"))
    several = placed.groupBy("gid").agg(F.min("label").alias("x"), F.max("label").alias("y"), *hub).where("x <> y").drop("x", "y")
    out = written(placed.join(several, "gid"), "mixed")
    forget(groups)
    release(groups.sparkSession)
    return out


def _by_unit(units: DataFrame, parts: int) -> DataFrame:
    return units.repartition(parts, "gid", "qb", "tb").sortWithinPartitions("gid", "qb", "tb")


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows in batches that end with their units, and where each unit begins."""
    rest: list[pa.RecordBatch] = []

    def cut(batch: pa.RecordBatch) -> np.ndarray:
        cols = [batch.column(c).to_numpy() for c in ("gid", "qb", "tb")]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        got = pa.concat_batches(rest)
        start = cut(got)
        if len(start) > 1:
            yield got.slice(0, start[-1]), start[:-1]
            rest = [got.slice(start[-1])]
        else:
            rest = [got]
    if rest:
        got = pa.concat_batches(rest)
        yield got, cut(got)


def _pairs_of(batch: pa.RecordBatch, start: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, target) of a unit that components, sizes and shared tokens allow, some at a time; the query is in the lighter component (ties by name)."""
    n, m, weight, label = (batch.column(c).to_numpy() for c in ("n", "m", "weight", "label"))
    query, target = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("query", "target"))
    end = np.append(start[1:], batch.num_rows)
    unit = np.searchsorted(start, np.arange(batch.num_rows), side="right") - 1
    asks = np.flatnonzero(query)
    width = (end - start)[unit[asks]]
    turn = np.cumsum(width) // _PAIRS
    for own in np.split(np.arange(len(asks)), np.flatnonzero(np.diff(turn)) + 1):
        w = width[own]
        a = np.repeat(asks[own], w)
        b = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + start[unit[a]]
        lighter = (weight[a] < weight[b]) | (weight[a] == weight[b]) & (label[a] < label[b])
        ok = lighter & target[b] & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & ((100 + percent) * np.minimum(m[a], m[b]) >= percent * (n[a] + n[b]))
        yield a[ok], b[ok]


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (one a row, in bytes) at half their length and so on down to ``size`` bytes."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _compared(batch: pa.RecordBatch, start: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (query, target) that the bitmaps allow, and the bits in which they differ as a share of their tokens."""
    n = batch.column("n").to_numpy()
    raw = batch.column("bits").to_pylist()
    length = np.array([len(x) for x in raw])
    table: dict[int, np.ndarray] = {}
    place = np.zeros(batch.num_rows, np.int64)
    for size in np.unique(length).tolist():
        own = np.flatnonzero(length == size)
        place[own] = np.arange(len(own))
        table[size] = np.frombuffer(b"".join(raw[i] for i in own), np.uint8).reshape(len(own), size)
    for a, b in _pairs_of(batch, start, percent):
        for la, lb in zip(*np.unique(np.stack([length[a], length[b]]), axis=1).tolist(), strict=True) if len(a) else ():
            own = np.flatnonzero((length[a] == la) & (length[b] == lb))
            small, step = min(la, lb), max(1, (8 << 20) // max(la, lb))
            for at in range(0, len(own), step):
                i, j = a[own[at : at + step]], b[own[at : at + step]]
                differ = np.bitwise_count((_folded(table[la][place[i]], small) ^ _folded(table[lb][place[j]], small)).view(np.uint64)).sum(axis=1, dtype=np.int64)
                both = n[i] + n[j]
                ok = differ <= both - 2 * -(-percent * both // (100 + percent))
                yield i[ok], j[ok], differ[ok] / both[ok]


def _nearest(percent: int):
    """For each query of a unit the target that the bitmaps find nearest, if they allow any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start in _whole_units(batches):
            least, target = np.full(batch.num_rows, np.inf), np.zeros(batch.num_rows, np.int64)
            for i, j, differ in _compared(batch, start, percent):
                order = np.lexsort((differ, i))
                i, j, differ = i[order], j[order], differ[order]
                first = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
                i, j, differ = i[first], j[first], differ[first]
                better = differ < least[i]
                least[i[better]], target[i[better]] = differ[better], j[better]
            own = np.flatnonzero(np.isfinite(least))
            k = batch.column("k")
            yield pa.RecordBatch.from_arrays([k.take(pa.array(own)), k.take(pa.array(target[own]))], ["a", "b"])

    return run


def _clusters(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the numbers below ``n`` that each is connected to by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _plausible(percent: int):
    """Members with a partner that the bitmaps allow, once each, in a new group for the components that such pairs connect, named by the heaviest.

    What is made is no more than a row a member read, however many of its pairs are allowed, and groups
    found in many units and tasks are mostly the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start in _whole_units(batches):
            label, weight, n = (batch.column(c).to_numpy() for c in ("label", "weight", "n"))
            labels, first, code = np.unique(label, return_index=True, return_inverse=True)
            order = np.lexsort((labels, -weight[first]))  # heavy ones first
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            code, root, some = rank[code], np.arange(len(order)), np.zeros(batch.num_rows, bool)
            for i, j, _ in _compared(batch, start, percent):
                some[i] = some[j] = True
                root = _clusters(np.concatenate([root, code[i]]), np.concatenate([np.arange(len(root)), code[j]]), len(root))
            at = np.flatnonzero(some)
            raw = np.frombuffer(b"".join(batch.column("k").take(pa.array(at)).to_pylist()), ">u8").reshape(-1, 2)
            _, one = np.unique(raw, axis=0, return_index=True)  # a member of several units is one
            at = at[one]
            yield pa.RecordBatch.from_arrays([pa.array(labels[order][root[code[at]]]), batch.column("k").take(pa.array(at)), pa.array(n[at]), pa.array(np.full(len(at), _WHOLE))], ["gid", "k", "n", "m"])

    return run


def _search(percent: int):
    """Links between members of different components of a unit that the bitmaps allow, but for those that earlier links of the task imply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := joined.get(x, x)) != x:
                joined[x] = joined.get(up, up)
                x = up
            return x

        for batch, start in _whole_units(batches):
            left, right = [], []
            k, label, raw = (batch.column(c).to_pylist() for c in ("k", "label", "tokens"))
            for a, b, _ in _compared(batch, start, percent):
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    if root(label[i]) != root(label[j]) and _alike(np.frombuffer(raw[i], np.uint64), np.frombuffer(raw[j], np.uint64), percent):
                        joined[root(label[i])] = root(label[j])
                        left.append(k[i])
                        right.append(k[j])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return run


def _narrow(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    few = keys.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), ["doc", "mark"], how)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document row: id, n_shingles, component_id (least id of its component, itself included), class_key (equal sets share it).

    Two documents link if the intersection of their shingle sets is ``percent`` or more of the union.
    Null and empty texts and texts without words have empty sets and link with nothing, not with
    each other. Ids are integers; very long texts are sets like others; an empty table has no rows. A null id counts as the largest number and a null component as such. Repeated rows
    are members of one class; columns other than the two named are not read.
    """
    spark = docs.sparkSession
    steady(spark)
    parts = shuffle_parts(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(document(docs, id_col).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))
    members = written(keyed.mapInArrow(_members(words), "doc long, mark long, k binary, n long"), "members")
    classes = written(members.where("n > 0").groupBy("k").agg(F.min(F.struct("doc", "mark")).alias("one"), F.first("n").alias("n")), "classes")
    copies = members.join(classes.select("one.doc", "one.mark"), ["doc", "mark"], "left_anti").select("doc", "mark").distinct()
    single = _narrow(keyed, written(copies, "copies"), "left_anti")  # one row of each class, but for repeated rows

    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = parts * max(1, -(-total // (parts * 8_000_000)))
    named = by_bucket(single.select("text").mapInArrow(_names(words, buckets), "bucket int, blob binary"), buckets)
    counted = written(named.mapInArrow(_counted(FREQUENT), "names binary, counts binary, bits array<long>"), "names")
    frequent = spark.sparkContext.broadcast(frequent_names(counted))  # MAX_FREQUENT names at most
    forget(counted)
    del named, counted
    release(spark)

    entries = single.select("text").mapInArrow(_index(words, buckets, frequent, percent), "bucket int, keys binary, places binary, rests binary, names binary, sizes binary")
    # Groups come out of the buckets with equal ones removed; those equal across buckets are removed here.
    groups = written(by_bucket(entries, buckets).mapInArrow(_groups(percent), "gid long, k binary, n long, m long, hub binary, hub_n long, hub_m long").dropDuplicates(["gid", "k"]), "groups")
    frequent.destroy()
    del entries, frequent
    release(spark)

    wanted = written(classes.join(groups.select("k").distinct(), "k", "left_semi").select("one.doc", "one.mark", "k"), "wanted")
    sets = written(_narrow(keyed, wanted, "inner").select("k", "text").mapInArrow(_tokens(words), "k binary, tokens binary").dropDuplicates(["k"]), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("k").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("k").alias("b"), F.col("tokens").alias("tb"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(percent), "a binary, b binary")

    def linked(pairs: DataFrame) -> DataFrame:
        tried = written(pairs, "pairs")
        links = written(verified(tried), "links")
        forget(tried)
        return links

    labels = components(linked(groups.where((F.col("k") > F.col("hub")) & similar(F.col("n"), F.col("m"), F.col("hub_n"), F.col("hub_m"), percent)).select(F.col("hub").alias("a"), F.col("k").alias("b")).distinct()))
    release(spark)
    def joined(new: DataFrame) -> DataFrame:
        out = components(labels.select(F.col("k").alias("a"), F.col("label").alias("b")).unionByName(new))
        release(spark)
        return out

    for turn in range(1, STAR_ROUNDS + 1):
        groups = _mixed(groups, labels, F.min(F.struct(F.xxhash64("k", F.lit(turn)).alias("h"), "k", "n", "m", "label")).alias("hub"))
        new = groups.where((F.col("label") != F.col("hub.label")) & similar(F.col("n"), F.col("m"), F.col("hub.n"), F.col("hub.m"), percent)).select(F.least("k", "hub.k").alias("a"), F.greatest("k", "hub.k").alias("b"))
        labels = joined(linked(new.distinct()))

    bits = written(sets.mapInArrow(_bitmaps(COARSE), "k binary, bits binary"), "bitmaps")

    def units(bits: DataFrame) -> DataFrame:
        # Here a component is told by a 64-bit hash of its name.
        weights = labels.groupBy("label").agg((F.count(F.lit(1)) + 1).alias("weight"))
        info = bits.join(labels.join(weights, "label"), "k", "left").select("k", F.xxhash64(F.coalesce("label", "k")).alias("label"), F.coalesce("weight", F.lit(1)).alias("weight"), "bits")
        return _units(groups.select("gid", "k", "n", "m"), written(info, "info"))

    def paired(bits: DataFrame) -> DataFrame:
        out = written(_by_unit(units(bits), buckets).mapInArrow(_plausible(percent), _GROUP).dropDuplicates(["gid", "k"]), "paired")
        release(spark)
        return out

    groups = _mixed(groups, labels)
    near = _by_unit(units(bits), buckets).mapInArrow(_nearest(percent), "a binary, b binary")
    labels = joined(linked(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    groups = _mixed(groups, labels)
    groups = paired(bits)
    fine = written(sets.join(groups.select("k").distinct(), "k", "left_semi").mapInArrow(_bitmaps(FINE), "k binary, bits binary"), "bitmaps")
    groups = paired(fine)
    left = units(fine).join(sets, "k")
    labels = joined(written(_by_unit(left, buckets).mapInArrow(_search(percent), "a binary, b binary"), "links"))

    placed = members.join(labels, "k", "left").select("doc", "n", "k", F.when(F.col("n") > 0, F.coalesce("label", "k")).alias("label"))
    firsts = written(placed.where("n > 0").groupBy("label").agg(F.min("doc").alias("first")), "firsts")  # a table, so that a hot label can be split
    out = placed.join(firsts, "label", "left")
    real = lambda c: F.when(c != LAST, c)
    return out.select(real(F.col("doc")).alias(docs.select(id_col).columns[0]), F.col("n").alias("n_shingles"), real(F.coalesce("first", "doc")).alias("component_id"), F.col("k").alias("class_key"))
