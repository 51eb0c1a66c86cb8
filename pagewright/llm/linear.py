"""Logistic regression on hashed features, trained by follow-the-regularised-leader (FTRL-Proximal) updates, and
what it is fitted on: all labelled documents, read in blocks, or a bounded sample of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as T
from .common import BROADCAST_BYTES, delete, place, weight, written

#: Hashes of ids are below this.
HASHES = 1 << 30
#: About so many labelled documents are in memory at once while a model is fitted on all of them.
BLOCK = 4096


def sigmoid(x: np.ndarray | float):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-Proximal with L1 and L2. The last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        return w

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ x) - y) * x
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, seed: int = 0, more: np.ndarray | None = None) -> Ftrl:
        """``more`` has a row's values of the last coordinates before the bias, where all rows have them."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            self.once(rows, y, rng, more)
        return self

    def once(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rng: np.random.Generator, more: np.ndarray | None = None) -> None:
        """An update by each row, in an order drawn anew."""
        k = 0 if more is None else more.shape[1]
        tail = np.arange(len(self.z) - 1 - k, len(self.z))
        ends = np.ones((len(rows), k + 1))
        if k:
            ends[:, :k] = more
        for i in rng.permutation(len(rows)):
            at, x = rows[i]  # put together anew each time: a sample may be large
            self.update(np.concatenate((at, tail)), np.concatenate((x, ends[i])), y[i])

    def predict(self, rows: list[tuple[np.ndarray, np.ndarray]], more: np.ndarray | None = None) -> np.ndarray:
        w = self.weights()
        if not rows:
            return np.zeros(0)
        logit = np.array([w[at] @ x for at, x in rows]) + w[-1]
        return sigmoid(logit if more is None else logit + more @ w[len(w) - 1 - more.shape[1] : -1])


def _marked(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, _y, _h: an id's largest label and its hash, without null labels and ids."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    return marked.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)))


@dataclass
class Examples:
    """Features of all labelled documents, a written table (b, h, y, key, n, packed) in ``blocks`` blocks by ranges of
    the hash of the id, h."""

    table: DataFrame
    blocks: int

    def __post_init__(self):
        self.block = lru_cache(1)(self.block)  # if there is but one block, it stays

    def block(self, i: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(hash of id, label, features, values) of a block's documents, in order of the hash."""
        rows = self.table.where(F.col("b") == i).select("h", "y", "key", "n", "packed").toArrow()
        made = sorted(zip(*(rows.column(j).to_pylist() for j in range(5))))
        return [(h, y, *unpack(n, packed)) for h, y, _, n, packed in made]


def pack(at: np.ndarray, x: np.ndarray) -> bytes:
    """Features in ascending order, as steps, and values: all first bytes, all second ones and so on, compressed."""
    both = np.concatenate((np.diff(at, prepend=0).astype(np.uint32), x.astype(np.float32).view(np.uint32)))
    return pa.Codec("zstd", compression_level=1).compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def unpack(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32)
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, decompressed_size=8 * n), np.uint8).reshape(4, 2 * n)
    both = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
    return np.cumsum(both[:n], dtype=np.uint32), both[n:].view(np.float32)


def examples(docs: DataFrame, labels: DataFrame, label: str, featurise, id_column: str = "doc_id", text: str = "text") -> Examples:
    """Every labelled document, in blocks of about ``BLOCK``, which do not depend on how rows are spread.

    ``featurise`` turns a string array into one (features, values) pair a row, features in ascending order. Null
    labels and ids are left out; of a repeated id the largest label counts; documents of equal features count once,
    where the hash of the id is least. Texts are not shuffled: as many labels as may be broadcast meet the documents
    at a time. Features are shuffled once. Call it within ``scratch``.
    """
    spark = docs.sparkSession
    marked = written(_marked(labels, label).withColumnRenamed("doc_id", "_doc"), "labels")
    passes = max(1, -(-weight(marked) // BROADCAST_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in T.slices(batch.column(2)):
                part = batch.slice(a, b - a)
                made = featurise(part.column(2))
                keys = [hashlib.sha256(at.astype(np.uint32).tobytes() + x.astype(np.float32).tobytes()).digest() for at, x in made]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array([len(at) for at, _ in made], pa.int32()), pa.array([pack(*m) for m in made], pa.binary())], names=["h", "y", "key", "n", "packed"])

    columns = "h long, y int, key binary, n int, packed binary"
    path = place(spark, "features")
    for i in range(passes):
        some = marked.where(F.pmod("_h", F.lit(passes)) == i)
        found = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(some), F.col("_id") == F.col("_doc"))
        found.select("_h", "_y", "_text").mapInArrow(run, columns).write.mode("append").parquet(path)
    made = spark.read.schema(columns).parquet(path)
    blocks = max(1, -(-made.count() // BLOCK))

    # rows whose features a row of a lesser hash has too: named by rows without features, which are sorted before them
    narrow = made.select("h", "y", "key")
    first = narrow.groupBy("key").agg(F.min(F.struct("h", "y")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = narrow.join(first, "key").where(F.struct("h", "y") != F.col("_first")).distinct()
    every = made.unionByName(later.select("h", "y", "key", F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("packed")))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for *row, named in zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)), batch.column(4).is_null().to_pylist()):
                keep.append(row != last and not named)
                last = row
            yield batch.filter(pa.array(keep, pa.bool_()))

    to = place(spark, "examples")
    ranged = every.select(F.expr(f"cast(h * {blocks} div {HASHES} as int) b"), "h", "y", "key", "n", "packed").repartitionById(blocks, F.col("b"))
    ranged.sortWithinPartitions("h", "y", "key", F.col("n").isNotNull()).mapInArrow(distinct, f"b int, {columns}").write.partitionBy("b").parquet(to)
    delete(spark, path)
    return Examples(spark.read.schema(f"{columns}, b int").parquet(to), blocks)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, featurise, id_column: str = "doc_id", text: str = "text") -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(hash of id, label, features, values) of about ``most`` labelled documents at most, in order of the hash.

    ``featurise`` turns a string array into one (features, values) pair a row. Documents are picked by a hash of
    the id, so the choice does not depend on how rows are spread. Null labels and ids are left out; of a repeated
    id the largest label counts; documents of equal features count once.
    """
    marked = _marked(labels, label)
    share = most / max(most, marked.count())
    picked = marked.where(F.col("_h") < int(share * HASHES)).withColumnRenamed("doc_id", "_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in T.slices(batch.column(2)):
                part = batch.slice(a, b - a)
                made = featurise(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([at.astype(np.uint32).tobytes() for at, _ in made], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in made], pa.binary())], names=["h", "y", "at", "x"])

    # about `most` narrow rows: bounded, so broadcasting it is
    got = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), F.col("_id") == F.col("_doc")).select("_h", "_y", "_text").mapInArrow(run, "h long, y int, at binary, x binary")
    seen, out = set(), []
    rows = got.toArrow()
    for h, y, at, x in sorted(zip(*(rows.column(i).to_pylist() for i in range(4)))):
        if (at, x) not in seen:
            seen.add((at, x))
            out.append((h, y, np.frombuffer(at, np.uint32), np.frombuffer(x, np.float32)))  # views of the bytes
    return out
