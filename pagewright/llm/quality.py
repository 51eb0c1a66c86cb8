"""Quality classification: logistic regression on hashed token n-grams, trained by follow-the-regularised-leader.

Tokens are words, case kept, and runs of punctuation; single tokens and pairs are hashed into 2^20 coordinates. A
feature's value is its share of the document's features, so long and short texts are scored alike, and scoring is
a sparse dot product: the mean weight of the tokens and pairs that occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as T
from .common import scratch
from .linear import Examples, Ftrl, examples, sigmoid, unpack

BITS, SCALE, EPOCHS, KEPT, HELD = 20, 20.0, 3, 0.999, 5


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates of tokens and their row offsets, then the same of pairs."""
    w = T.tokens(texts)
    pairs, rows = T.shingles(w.hash, w.rows, 2)
    shift = np.uint64(64 - BITS)
    return (w.hash >> shift).astype(np.int64), w.rows, (pairs >> shift).astype(np.int64), rows


def _features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    one, r1, two, r2 = _hashed(texts)
    out = []
    for i in range(len(texts)):
        every = np.concatenate((one[r1[i] : r1[i + 1]], two[r2[i] : r2[i + 1]]))
        at, count = np.unique(every, return_counts=True)
        out.append((at, count * (SCALE / max(1, len(every)))))
    return out


def _sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[rows[1:]] - total[rows[:-1]]


@dataclass
class Quality:
    weights: np.ndarray
    threshold: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        w = self.weights
        for a, b in T.slices(texts):
            one, r1, two, r2 = _hashed(texts.slice(a, b - a))
            n = np.maximum(1, np.diff(r1) + np.diff(r2))
            out[a:b] = sigmoid((_sums(w[one], r1) + _sums(w[two], r2)) * SCALE / n + w[-1])
        return out


def fit(docs: DataFrame, labels: DataFrame, epochs: int = EPOCHS, kept: float = KEPT, id_column: str = "doc_id", text: str = "text") -> Quality:
    """Fitted on every labelled document (labels: doc_id, quality 0 or 1).

    A fifth of them, by a hash of the id, is held out to set the threshold: the largest, up to 0.5, that keeps the
    share ``kept`` of the good ones. The final weights are of all. Documents are visited in blocks by ranges of the
    hash, and in an order drawn anew each epoch within a block. FTRL's updates follow one another, so the driver makes
    them, with a block in memory at a time. Without labels every score is 0.5 and all is kept.
    """
    spark = docs.sparkSession
    with scratch(spark):
        every = examples(docs, labels, "quality", _features, id_column, text)
        size = 1 << BITS
        trial, final = (Ftrl(size, alpha=1.0, l1=0.3, l2=0.1) for _ in range(2))
        one, two = (np.random.default_rng(0) for _ in range(2))
        seen = held = 0
        for epoch in range(epochs):
            for i in range(every.blocks):
                rows = every.block(i)
                x, y = [r[2:] for r in rows], np.array([r[1] for r in rows], float)
                out = np.array([r[0] for r in rows], np.int64) % HELD == 0
                inside = np.flatnonzero(~out)
                trial.once([x[j] for j in inside], y[inside], one)
                final.once(x, y, two)
                if epoch == 0:
                    seen, held = seen + len(rows), held + int((out & (y > 0)).sum())
        if not seen:
            return Quality(np.zeros(size + 1), 0.5)
        return Quality(final.weights(), min(0.5, _quantile(every, trial, held, 1 - kept)) if held else 0.5)


def _quantile(every: Examples, trial: Ftrl, count: int, share: float) -> float:
    """What the share of the ``count`` good documents held out score less than, interpolated."""
    w = trial.weights()
    at, size = np.flatnonzero(w), len(w)
    shared = every.table.sparkSession.sparkContext.broadcast((at, w[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(size)
        w[shared.value[0]] = shared.value[1]
        for batch in batches:
            rows = (unpack(*r) for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([sigmoid(w[k] @ x + w[-1]) for k, x in rows], pa.float64())], names=["p"])

    rank = (count - 1) * share
    good = every.table.where((F.col("h") % HELD == 0) & (F.col("y") > 0)).select("n", "packed").mapInArrow(run, "p double")
    least = [r.p for r in good.orderBy("p").limit(int(rank) + 2).collect()]
    return float(np.quantile(least[int(rank) :], rank - int(rank)))


def scored(model: Quality, text: str | Column, spark) -> Column:
    """A struct of ``score`` and ``keep``."""
    # of a fixed size, whatever the corpus: only the weights that are not zero travel
    at = np.flatnonzero(model.weights)
    shared = spark.sparkContext.broadcast((at, model.weights[at], len(model.weights), model.threshold))
    held: list[Quality] = []

    @F.arrow_udf("score double, keep boolean")
    def score(texts: pa.Array) -> pa.Array:
        if not held:
            k, v, n, threshold = shared.value
            w = np.zeros(n)
            w[k] = v
            held.append(Quality(w, threshold))
        p = held[0].score(texts)
        return pa.StructArray.from_arrays([pa.array(p), pa.array(p >= held[0].threshold)], names=["score", "keep"])

    return score(F.col(text) if isinstance(text, str) else text)


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, ``score`` (probability of good quality) and ``keep``, for every row of docs.

    A null or empty text is scored by the bias alone. Repeated rows and null ids are scored like others; the whole
    text counts; other columns are not read. An empty df gives an empty result.
    """
    model = fit(docs, labels, id_column=id_column, text=text, **options)
    return docs.select(F.col(id_column).alias("doc_id"), scored(model, text, docs.sparkSession).alias("_s")).select("doc_id", "_s.*")
