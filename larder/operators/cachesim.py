"""Cache replays: LRU by size and TTL by age, one cache at a time over its ordered accesses."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(accesses: DataFrame, cache: str, order: list[str], key: str, decide, extra: tuple[str, ...] = ()) -> DataFrame:
    """Stream each partition's rows, sorted by cache and order, through a decision that may change its cache's state; one state is held at a time."""
    seen = list(dict.fromkeys([cache, *order, key, *extra]))

    def run(batches):
        current, state = object(), None
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in seen}
            hits = []
            for i, c in enumerate(cols[cache]):
                if c != current:
                    current, state = c, OrderedDict()
                hits.append(decide(state, cols, i))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in seen], pa.array(hits)], [*seen, "hit"])

    kinds = ", ".join(f"{c} {accesses.schema[c].dataType.simpleString()}" for c in seen)
    return accesses.select(*seen).repartition(F.col(cache)).sortWithinPartitions(cache, *order).mapInArrow(run, f"{kinds}, hit boolean")


def lru_hits(accesses: DataFrame, cache: str, order: list[str], key: str, max_size: int) -> DataFrame:
    """Whether each access hits a least-recently-used cache of ``max_size`` entries (0: unlimited). State is bounded by the size."""

    def decide(state, cols, i):
        k = cols[key][i]
        hit = k in state
        state[k] = True
        state.move_to_end(k)
        if max_size and len(state) > max_size:
            state.popitem(last=False)
        return hit

    return replay(accesses, cache, order, key, decide)


def ttl_hits(accesses: DataFrame, cache: str, order: list[str], key: str, ts: str, ttl: int) -> DataFrame:
    """Whether each access hits an entry set no longer than ``ttl`` ago (0: for ever); a hit does not renew it."""

    def decide(state, cols, i):
        k, t = cols[key][i], cols[ts][i]
        hit = k in state and (not ttl or t - state[k] <= ttl)
        if not hit:
            state[k] = t
        return hit

    return replay(accesses, cache, order, key, decide, (ts,))
