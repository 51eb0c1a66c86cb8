"""Toxicity by a classifier chain.

Categories are predicted one after another. Each has a linear model on the words of the text, on the stems of its
longer words (so that an inflected or compounded slur is known by its beginning) and on the probabilities of the
categories before it; while training, those probabilities are out of fold, so a later model
sees them as good as they will be on new texts.

The labels say only whether a document is toxic. The earlier categories are weakly labelled: toxic, and holding a
seed word of the category as a word of its own. The last one, ``toxic``, is the label itself, on all words: it is not confined to the
seeds. A category of which the sample has no example is left out of the chain.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as T
from .common import fresh
from .linear import Ftrl, labelled, sigmoid

BITS, TRAIN_ROWS, FOLDS, EPOCHS, L1, LEAST_L1 = 20, 6000, 3, 3, 4.0, 2.5
STEMS = (5, 6, 7)  # characters, of words that have more
CATEGORIES: dict[str, Sequence[str]] = {
    "insult": ("idiot", "moron", "loser", "clown", "fool", "imbecile", "stupid", "dumb"),
    "contempt": ("worthless", "pathetic", "disgusting", "trash", "scum", "garbage", "filth", "vermin"),
}


def _coordinates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all rows, with repeats, and the row of each."""
    w = T.words(texts)
    row = w.row_of()
    char = np.append(0, np.cumsum((w.data & 0xC0) != 0x80))  # characters before each byte
    begins = np.append(np.flatnonzero((w.data & 0xC0) != 0x80), len(w.data))
    first, length = char[w.start], char[w.end] - char[w.start]
    hashes, rows = [w.hash], [row]
    for n in STEMS:
        longer = np.flatnonzero(length > n)
        stem = T.span_hash(w.prefix, w.start[longer], begins[first[longer] + n])
        hashes.append(T.mix(stem + np.uint64(n)))
        rows.append(row[longer])
    return (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)


def _features(texts: pa.Array, seeds: Sequence[np.ndarray] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
    """A row's distinct features, and for each set of word hashes whether it holds one of them."""
    at, row = _coordinates(texts)
    row, at = np.divmod(np.unique(row * (1 << BITS) + at), 1 << BITS)
    edge = np.searchsorted(row, np.arange(len(texts) + 1))
    w = T.words(texts)
    held = np.zeros((len(texts), len(seeds)))
    for j, hashes in enumerate(seeds):
        held[w.row_of()[np.isin(w.hash, hashes)], j] = 1
    return [(at[x:y], held[i]) for i, (x, y) in enumerate(zip(edge[:-1], edge[1:]))]


@dataclass
class Chain:
    names: list[str]
    weights: list[np.ndarray]  # words, then earlier categories, then the bias
    threshold: float

    def __post_init__(self):
        size = 1 << BITS
        live = np.zeros(size, bool)
        for w in self.weights:
            live |= w[:size] != 0
        self.live = live

    def __getstate__(self):
        size = 1 << BITS
        kept = [np.flatnonzero(w) for w in self.weights]
        return self.names, [(k.astype(np.int32), w[k], len(w)) for k, w in zip(kept, self.weights)], self.threshold, size

    def __setstate__(self, state):
        self.names, packed, self.threshold, _ = state
        self.weights = []
        for k, v, n in packed:
            w = np.zeros(n)
            w[k] = v
            self.weights.append(w)
        self.__post_init__()

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probabilities, a column a category."""
        size = 1 << BITS
        out = np.zeros((len(texts), len(self.names)))
        for a, b in T.slices(texts):
            at, row = _coordinates(texts.slice(a, b - a))
            hit = np.flatnonzero(self.live[at])
            row, at = np.divmod(np.unique(row[hit] * size + at[hit]), size)  # a feature counts once
            for j, weight in enumerate(self.weights):
                logit = np.bincount(row, weight[at], minlength=b - a) + weight[-1] + out[a:b, :j] @ weight[size:-1]
                out[a:b, j] = sigmoid(logit)
        return out


def fit(docs: DataFrame, labels: DataFrame, categories: Mapping[str, Sequence[str]] | None = None, train_rows: int = TRAIN_ROWS, folds: int = FOLDS, epochs: int = EPOCHS, id_column: str = "doc_id", text: str = "text") -> Chain:
    """A chain fitted on about ``train_rows`` labelled documents (labels: doc_id, toxic), picked by a hash of the id.

    The threshold is the one that does best out of fold by F0.5, in which a clean document rejected weighs more than
    a toxic one missed. Without toxic examples nothing is toxic. The models of a category are fitted side by side,
    a task each.
    """
    rows, names = sample(docs, labels, categories, train_rows, id_column, text)
    spark = docs.sparkSession
    context, shared = spark.sparkContext, []

    def side_by_side(task, count: int) -> list:
        if not shared:
            shared.append(context.broadcast(Sample.of(rows)))  # bounded: train_rows texts
        held = shared[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(task(held.value, i))], pa.binary())], names=["i", "made"])

        made = spark.range(0, count, 1, count).mapInArrow(run, "i long, made binary").collect()
        return [pickle.loads(r.made) for r in sorted(made)]

    return train(rows, names, folds, epochs, side_by_side)


def sample(docs: DataFrame, labels: DataFrame, categories: Mapping[str, Sequence[str]] | None = None, train_rows: int = TRAIN_ROWS, id_column: str = "doc_id", text: str = "text") -> tuple[list, list[str]]:
    """The rows to train on, and the names of the categories whose seeds their last field tells of."""
    seeds = CATEGORIES if categories is None else categories
    hashes = [T.words(pa.array(list(v), pa.string())).hash for v in seeds.values()]
    return labelled(docs, labels, "toxic", train_rows, lambda texts: _features(texts, hashes), id_column, text), list(seeds)


@dataclass
class Sample:
    """Rows' features end to end, and the hash of each row's id."""

    at: np.ndarray
    edge: np.ndarray
    hashes: np.ndarray

    @staticmethod
    def of(rows: list) -> Sample:
        size = [len(r[2]) for r in rows]
        return Sample(np.concatenate([r[2] for r in rows]).astype(np.int32), np.concatenate(([0], np.cumsum(size))), np.array([r[0] for r in rows]))

    def rows(self, which: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        ones = np.ones(int(np.diff(self.edge).max(initial=0)))
        return [(self.at[a:b], ones[: b - a]) for a, b in zip(self.edge[which], self.edge[which + 1])]


def one_by_one(rows: list):
    own = Sample.of(rows)
    return lambda task, count: [task(own, i) for i in range(count)]


def train(rows: list[tuple[int, int, np.ndarray, np.ndarray]], names: Sequence[str], folds: int = FOLDS, epochs: int = EPOCHS, each=None) -> Chain:
    """The chain of (hash of id, label, features, seeds held) rows. ``each(task, count)`` runs task(sample, i) for every i."""
    size = 1 << BITS
    y = np.array([r[1] for r in rows], float)
    if not y.any():
        w = np.zeros(size + 1)
        w[-1] = -35.0
        return Chain(["toxic"], [w], 0.5)
    each = each or one_by_one(rows)
    l1 = max(LEAST_L1, L1 * len(rows) / TRAIN_ROWS)  # evidence for a word grows with the sample, and so must this
    fold = np.array([r[0] for r in rows]) % folds
    targets = {name: y * np.array([r[3][j] for r in rows]) for j, name in enumerate(names)} | {"toxic": y}
    done, weights, before = [], [], np.zeros((len(rows), 0))
    for name, t in targets.items():
        if not t.any():
            continue

        def task(sample: Sample, i: int, t=t, before=before):
            """Predictions for fold i by the others; after the folds, the weights of all."""
            inside, rest = np.flatnonzero(fold != i), np.flatnonzero(fold == i)
            model = Ftrl(size + before.shape[1], l1=l1).fit(sample.rows(inside), t[inside], epochs, more=before[inside])
            if i < folds:
                return model.predict(sample.rows(rest), more=before[rest])
            w = model.weights()
            return np.flatnonzero(w), w[w != 0]

        *parts, (at, w) = each(task, folds + 1)
        outside = np.zeros(len(rows))
        for i, p in enumerate(parts):
            outside[fold == i] = p
        done.append(name)
        weights.append(np.zeros(size + before.shape[1] + 1))
        weights[-1][at] = w
        before = np.column_stack((before, outside))
    p = before[:, -1]
    best, threshold = -1.0, 0.5
    for c in np.linspace(0.1, 0.9, 33):
        hit = ((p >= c) & (y > 0)).sum()
        precision, recall = hit / max(1, (p >= c).sum()), hit / y.sum()
        score = 1.25 * precision * recall / max(1e-9, 0.25 * precision + recall)
        if score > best + 1e-3 or (score > best - 1e-3 and abs(c - 0.5) < abs(threshold - 0.5)):
            best, threshold = max(best, score), float(c)
    chain = Chain(done, weights, threshold)
    none = chain.score(pa.array([""]))[0, -1]
    if none >= threshold:  # where few examples make a low threshold, what has no words is still no evidence
        chain.threshold = float(np.nextafter(none, 1.0))
    return chain


def scored(model: Chain, text: str | Column, spark) -> Column:
    """A struct: p_<category> for each category of the chain, and ``toxic``."""
    shared = spark.sparkContext.broadcast(model)
    names = [f"p_{n}" for n in model.names]

    @F.arrow_udf(", ".join(f"{n} double" for n in names) + ", toxic boolean")
    def score(texts: pa.Array) -> pa.Array:
        p = shared.value.score(texts)
        return pa.StructArray.from_arrays([*(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(p[:, -1] >= shared.value.threshold)], names=[*names, "toxic"])

    return score(F.col(text) if isinstance(text, str) else text)


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, a probability p_<category> for each category of the chain, and ``toxic``, for every row of docs.

    A null or wordless text gets the probability of no evidence and is not toxic. Repeated rows and null ids are scored like others;
    the whole text counts. An empty df gives an empty result.
    """
    model = fit(docs, labels, id_column=id_column, text=text, **options)
    return docs.select(F.col(id_column).alias("doc_id"), scored(model, text, docs.sparkSession).alias("_s")).select("doc_id", "_s.*")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the toxic ones. All columns pass through and rows keep their multiplicity."""
    model = fit(docs, labels, id_column=id_column, text=text, **options)
    (name,) = fresh(docs, "_toxicity")
    return docs.withColumn(name, scored(model, text, docs.sparkSession)).where(~F.col(f"{name}.toxic")).drop(name)
