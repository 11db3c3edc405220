"""Toxicity by classifier chains over words.

The categories of a chain are predicted one after the other by logistic models. A later model sees
the probabilities of the earlier categories as features; for training these are out-of-fold
predictions, so that it learns from probabilities as uncertain as those it will meet. A model's words
are those that a likelihood-ratio test ties to its category, so a model is a short table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

#: At most this many labelled rows, those with the smallest hashes of their ids, train the chain.
TRAIN_ROWS = 5_000
FOLDS = 3
#: Clean documents stay far below this: it is set for recall, from held-out scores.
THRESHOLD = 0.15
#: A word is a feature if it is in this many training documents or more and its G statistic is this large; the largest MAX_WORDS stay.
MIN_DOCS = 4
MIN_G = 18.0
MAX_WORDS = 256
RIDGE = 0.005
#: Beginnings of words of these lengths (bytes) are features beside the words, so that inflected forms count together.
STEMS = (4, 5, 6)
#: Words that tell the categories of a toxic document apart, a choice of ours as no table labels them. They label categories of the training rows; the models decide from the words they find.
CATEGORY_WORDS = {
    "insult": ("idiot", "moron", "loser", "clown", "fool", "jerk"),
    "contempt": ("stupid", "pathetic", "worthless", "dumb", "useless", "ridiculous"),
    "disgust": ("trash", "scum", "disgusting", "garbage", "filth", "vermin"),
}
#: The chain's order; the last category is the verdict.
CHAIN = (*CATEGORY_WORDS, "toxic")
_LETTERS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def names_of(word: bytes) -> list[int]:
    """64-bit names of a word and of its beginnings."""
    return [xxhash.xxh3_64_intdigest(word), *[xxhash.xxh3_64_intdigest(word[:n], seed=n) for n in STEMS if len(word) >= n]]


def features(text: bytes) -> np.ndarray:
    """Sorted distinct names of the text's lower-cased words."""
    return np.unique(np.array([x for w in set(words(text)) for x in names_of(w)], np.uint64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Linear:
    """A logistic model over the presence of words (sorted names) and a few earlier probabilities."""

    names: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def probability(self, flat: np.ndarray, row: np.ndarray, rows: int, dense: np.ndarray) -> np.ndarray:
        total = dense @ self.dense + self.bias
        if len(self.names) and len(flat):
            at = np.minimum(np.searchsorted(self.names, flat), len(self.names) - 1)
            hit = self.names[at] == flat
            total = total + np.bincount(row[hit], self.weights[at[hit]], rows)
        return _sigmoid(total)


def _choose(codes: np.ndarray, row: np.ndarray, size: int, y: np.ndarray) -> np.ndarray:
    """Features with the largest G statistics of presence against the label."""
    n, p = len(y), float(y.sum())
    if not 0 < p < n:
        return np.zeros(0, np.int64)
    have = np.bincount(codes, minlength=size).astype(float)
    both = np.bincount(codes, y[row], size)

    def term(o, e):
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-300) / e), 0.0)

    rest = np.maximum(n - have, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (term(both, have * p / n) + term(have - both, have * (n - p) / n) + term(p - both, rest * p / n) + term(n - p - have + both, rest * (n - p) / n))
    g = np.where((have >= MIN_DOCS) & np.isfinite(g), g, 0)
    best = np.argsort(-g, kind="stable")[:MAX_WORDS]
    return np.sort(best[g[best] >= MIN_G])


def _fit(codes, row, names, dense, y) -> Linear:
    """Choose words, then Newton steps on the ridge-penalised logistic loss; deterministic."""
    chosen = _choose(codes, row, len(names), y)
    n, k, d = len(y), len(chosen), dense.shape[1]
    x = np.zeros((n, k + d + 1))
    if k:
        at = np.minimum(np.searchsorted(chosen, codes), k - 1)
        hit = chosen[at] == codes
        x[row[hit], at[hit]] = 1
    x[:, k : k + d] = dense
    x[:, -1] = 1
    share = (y.sum() + 0.5) / (n + 1)
    w = np.zeros(k + d + 1)
    w[-1] = np.log(share / (1 - share))
    if 0 < y.sum() < n:
        ridge = np.full(len(w), RIDGE)
        ridge[-1] = 1e-6
        for _ in range(25):
            p = _sigmoid(x @ w)
            grad = x.T @ (p - y) + ridge * w
            hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(hess, grad)
            w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-7:
                break
    return Linear(names[chosen], w[:k], w[k : k + d], float(w[-1]))


@dataclass
class Chain:
    names: tuple[str, ...]
    models: list[Linear] = field(default_factory=list)

    def probabilities(self, flat: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Rows by category, each from the words and the categories before it. flat, row: names of distinct words and the rows they are in."""
        out = np.zeros((rows, 0))
        for m in self.models:
            out = np.column_stack([out, m.probability(flat, row, rows, out)])
        return out


def train(feats: list[np.ndarray], labels: np.ndarray, names: tuple[str, ...], folds: int = FOLDS) -> Chain:
    """Fit the chain. Equal feature sets with equal labels count once, so that copies do not outvote other rows. A category without both classes is predicted by its share."""
    seen: dict[bytes, int] = {}
    for i, f in enumerate(feats):
        seen.setdefault(f.tobytes() + labels[i].tobytes(), i)
    own = sorted(seen.values())
    feats, labels = [feats[i] for i in own], labels[own].astype(float)
    n = len(feats)
    row = np.repeat(np.arange(n), [len(f) for f in feats])
    flat, codes = np.unique(np.concatenate(feats) if n else np.zeros(0, np.uint64), return_inverse=True)
    often = np.bincount(codes, minlength=len(flat)) >= MIN_DOCS  # the others can be no feature in any fold
    keep, place = often[codes], np.cumsum(often) - 1
    row, codes, flat = row[keep], place[codes[keep]], flat[often]
    chain, before, fold = Chain(names), np.zeros((n, 0)), np.arange(n) % folds
    for k in range(len(names)):
        y = labels[:, k]
        chain.models.append(_fit(codes, row, flat, before, y))
        outside = np.zeros(n)
        for f in range(folds):
            rest, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            place = np.full(n, -1)
            place[rest] = np.arange(len(rest))
            inside = fold[row] != f
            part = _fit(codes[inside], place[row[inside]], flat, before[rest], y[rest])
            place[held] = np.arange(len(held))
            outside[held] = part.probability(flat[codes[~inside]], place[row[~inside]], len(held), before[held])
        before = np.column_stack([before, outside])
    return chain


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hits = [{w.encode() for w in ws} for ws in CATEGORY_WORDS.values()]
    for batch, texts in blocks(batches):
        packed, marks = [], []
        for t in texts:
            own = set(words(t))
            packed.append(features(t).tobytes())
            marks.append([bool(own & ws) for ws in hits])
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(packed, pa.binary()), pa.array(marks, pa.list_(pa.bool_()))], ["toxic", "features", "marks"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Chain:
    """Train on at most ``rows`` labels and their documents. Rows without id or label are left out, of an id that repeats one text is taken; without any row, or without documents, the chain calls nothing toxic."""
    picked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).where("_id IS NOT NULL AND toxic IS NOT NULL")
    picked = picked.orderBy(F.xxhash64("_id"), "_id", "toxic").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(picked), "_id")  # the broadcast side has at most ``rows`` rows of two numbers
    found = found.groupBy("_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")  # one text of an id that repeats, so no more than ``rows``
    # The sample is bounded, so one task can hold its features and train; the driver gets the short models alone.
    made = found.mapInArrow(_featurise, "toxic int, features binary, marks array<boolean>").repartition(1).mapInArrow(_train_task, "chain binary").first()
    if made is None:
        return Chain(CHAIN, [Linear(np.zeros(0, np.uint64), np.zeros(0), np.zeros(k), -35.0) for k in range(len(CHAIN))])
    return pickle.loads(made[0])


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = sorted((r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("features", "toxic", "marks")], strict=True)), key=lambda r: r[:2])
    if got:
        feats = [np.frombuffer(f, np.uint64) for f, _, _ in got]
        y = np.array([[bool(t) and m for m in marks] + [bool(t)] for _, t, marks in got], bool)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(feats, y, CHAIN))], pa.binary())], ["chain"])


def _scored(carried, text_col: str):
    """Batches of rows and their probabilities by category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        chain: Chain = carried.value
        wanted = np.unique(np.concatenate([m.names for m in chain.models]))
        for batch, texts in blocks(batches, text_col):
            split = [words(t) for t in texts]
            size = [len(w) for w in split]
            coded = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
            own = [names_of(w) for w in coded.dictionary.to_pylist()]
            names, word = np.array([x for o in own for x in o], np.uint64), np.repeat(np.arange(len(own)), [len(o) for o in own])
            useful = np.isin(names, wanted)
            names, word = names[useful], word[useful]
            codes, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), size)
            hit = np.zeros(max(len(own), 1), bool)
            hit[word] = True
            keep = hit[codes] if len(codes) else np.zeros(0, bool)
            row, codes = row[keep], codes[keep]
            first, last = np.searchsorted(word, codes), np.searchsorted(word, codes, side="right")
            at = np.repeat(row, last - first)
            flat = names[np.arange(len(at)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)] if len(at) else names[:0]
            if len(at):
                order = np.lexsort((flat, at))
                flat, at = flat[order], at[order]
                fresh = np.concatenate([[True], (flat[1:] != flat[:-1]) | (at[1:] != at[:-1])])
                flat, at = flat[fresh], at[fresh]
            yield batch, chain.probabilities(flat, at, len(texts))

    return run


def _scorer(carried, id_name: str, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, probs in _scored(carried, "text")(batches):
            yield pa.RecordBatch.from_arrays([batch.column(id_name), *[pa.array(probs[:, k]) for k in range(probs.shape[1])]], [id_name, *[f"p_{n}" for n in names]])

    return run


def _keeper(carried, text_col: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, probs in _scored(carried, text_col)(batches):
            yield batch.filter(pa.array(probs[:, -1] < threshold))

    return run


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: id, a probability p_<category> for each category, rejected (the last one's reaches the threshold).

    Null and empty texts have no words and get the models' bias; repeated rows get the same answer;
    very long texts are read whole; an empty table has no rows; columns other than the two named are not read. The models are bounded: MAX_WORDS words each.
    """
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    id_name = picked.columns[0]
    kind = picked.schema[id_name].dataType.simpleString()
    carried = docs.sparkSession.sparkContext.broadcast(chain)
    scored = picked.mapInArrow(_scorer(carried, id_name, chain.names), f"{id_name} {kind}, " + ", ".join(f"p_{n} double" for n in chain.names))
    return scored.withColumn("rejected", F.col(f"p_{chain.names[-1]}") >= threshold)


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose last category stays below the threshold."""
    carried = docs.sparkSession.sparkContext.broadcast(chain)
    return docs.mapInArrow(_keeper(carried, text_col, threshold), docs.schema)
