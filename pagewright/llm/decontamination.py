"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are short and documents long, so the Jaccard similarity of the two says nothing. Items are therefore
partitioned by their number of shingles into classes (2^(m-1), 2^m], and for each class a document is read as
windows of 2^(m+1) shingles at steps of 2^m: an item that occurs lies whole in some window of its own scale. Item and
window are signed with the same ``hashes`` minima; one equal minimum makes a candidate. A minimum names a run of words,
so a match by chance is rare and one row a band is right. A whole item is at least a quarter of what it and its window
hold, so 48 minima miss 1 of a million; of an item of which one stretch occurs, just as much as ``containment`` asks, the
similarity is at least 0.136, and they miss 1 of 1,000. Pieces that lie further apart than a window add to containment
once the item is a candidate, but each window has to find it by its own share, for which there is no such bound.

Windows of all classes are unions of the same aligned blocks, so each hash function is computed once a shingle.
Each candidate is verified with the document's and the item's whole shingle sets.

Items are broadcast in passes of at most ``pass_bytes`` of shingles: a benchmark of any size is searched by the
same code, in as many scans as it needs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as T

SHINGLE, CONTAINMENT, HASHES = 5, 0.6, 48
PASS_BYTES = 16 << 20

_A = np.random.default_rng(20).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = ~np.uint64(0)


def _key(value: np.ndarray, m: int, i: int) -> np.ndarray:
    return value ^ T.mix(np.array([m * 64 + i + 1], np.uint64))[0]


class Items:
    """Search structure over (item id, text) pairs."""

    def __init__(self, ids: list, texts: list, shingle: int, hashes: int):
        w = T.words(pa.array(texts, pa.large_string()))
        self.ids, self.sets, self.gram = [], [], []
        for i, item in enumerate(ids):
            h = w.hash[w.rows[i] : w.rows[i + 1]]
            if not len(h):
                continue
            g = min(shingle, len(h))
            s, _ = T.shingles(h, np.array([0, len(h)]), g)
            self.ids.append(item)
            self.gram.append(g)
            self.sets.append(np.unique(s))
        self.grams = sorted(set(self.gram))
        self.by_gram = {}
        for g in self.grams:
            keys, owners, classes = [], [], set()
            for n in (n for n, x in enumerate(self.gram) if x == g):
                m = int(len(self.sets[n]) - 1).bit_length()
                classes.add(m)
                for i in range(hashes):
                    keys.append(_key((self.sets[n] * _A[i]).min(keepdims=True), m, i)[0])
                    owners.append(n)
            index = T.Index(np.array(keys, np.uint64))
            members = defaultdict(list)
            for p, n in zip(index.find(np.array(keys, np.uint64)).tolist(), owners):
                members[p].append(n)
            seen = np.zeros(1 << 20, bool)
            seen[(index.keys >> np.uint64(44)).astype(np.int64)] = True
            self.by_gram[g] = (sorted(classes), index, members, seen)


def _candidates(s: np.ndarray, rows: np.ndarray, classes: list[int], index: T.Index, members: dict, seen: np.ndarray, hashes: int) -> dict[int, set[int]]:
    """Items to verify by row of the slice."""
    found = defaultdict(set)
    count = np.diff(rows)
    live = np.flatnonzero(count)
    if not len(live):
        return found
    least = classes[0]

    def starts(m: int) -> tuple[np.ndarray, np.ndarray]:
        blocks = (count[live] + (1 << m) - 1) >> m
        return blocks, np.concatenate(([0], np.cumsum(blocks)))

    blocks, edge = starts(least)
    inside = np.arange(edge[-1]) - np.repeat(edge[:-1], blocks)
    cuts = np.repeat(rows[:-1][live], blocks) + (inside << least)
    levels = {least: (blocks, edge)}
    joins = {}
    for m in range(least + 1, classes[-1] + 1):
        levels[m] = starts(m)
        b, e = levels[m]
        joins[m] = np.repeat(levels[m - 1][1][:-1], b) + ((np.arange(e[-1]) - np.repeat(e[:-1], b)) << 1)
    for i in range(hashes):
        low = np.minimum.reduceat(s * _A[i], cuts)
        for m in range(least, classes[-1] + 1):
            if m > least:
                low = np.minimum.reduceat(low, joins[m])
            if m not in classes:
                continue
            b, e = levels[m]
            window = low.copy()  # each block with the next of its row
            window[:-1] = np.minimum(low[:-1], low[1:])
            window[e[1:] - 1] = low[e[1:] - 1]
            k = _key(window, m, i)
            near = np.flatnonzero(seen[(k >> np.uint64(44)).astype(np.int64)])
            pos = index.find(k[near])
            for at, p in zip(near[pos >= 0].tolist(), pos[pos >= 0].tolist()):
                found[int(live[np.searchsorted(e, at, side="right") - 1])].update(members[p])
    return found


def _search(items: Items, threshold: float, hashes: int, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            docs, item, share, size = [], [], [], []
            for a, b in T.slices(texts):
                w = T.words(texts.slice(a, b - a))
                for g in items.grams:
                    s, rows = T.shingles(w.hash, w.rows, g)
                    for row, ns in _candidates(s, rows, *items.by_gram[g], hashes).items():
                        own = T.Index(s[rows[row] : rows[row + 1]])
                        for n in sorted(ns):
                            part = float((own.find(items.sets[n]) >= 0).mean())
                            if part >= threshold:
                                docs.append(a + row)
                                item.append(items.ids[n])
                                share.append(part)
                                size.append(len(items.sets[n]))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(docs, pa.int64())), pa.array(item, out.field(1).type), pa.array(share, pa.float64()), pa.array(size, pa.int32())], schema=out)

    return run


def _passes(benchmark: DataFrame, item_column: str, item_text: str, shingle: int, hashes: int, pass_bytes: int) -> Iterator[Broadcast]:
    """The benchmark's items, broadcast a pass at a time."""
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    passes = -(-2 * size // pass_bytes) or 1  # eight bytes a shingle, six or so characters a word
    for k in range(passes):
        part = benchmark.where(F.pmod(F.xxhash64(item_text), F.lit(passes)) == k) if passes > 1 else benchmark
        rows = part.select(item_column, item_text).where(F.col(item_text).isNotNull()).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], shingle, hashes))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, containment: float = CONTAINMENT, hashes: int = HASHES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Pairs (doc_id, item_id, containment, shingles): the item's distinct word shingles that the document holds.

    A pair is given if that share is at least ``containment``. Shingles are runs of ``shingle`` words; an item of
    fewer words is one shingle, sought as a run of words of its own length. Null and wordless texts match nothing.
    Null ids are given as nulls. Repeated rows and tied pairs are each given. The whole text is searched, however
    long. Other columns are not read. An empty side gives an empty result.
    """
    kinds = {f.name: f.dataType for f in [*docs.select(F.col(id_column).alias("doc_id")).schema, *benchmark.select(F.col(item_column).alias("item_id")).schema]}
    schema = f"doc_id {kinds['doc_id'].simpleString()}, item_id {kinds['item_id'].simpleString()}, containment double, shingles int"
    from pyspark.sql.pandas.types import to_arrow_type

    out = pa.schema([("doc_id", to_arrow_type(kinds["doc_id"])), ("item_id", to_arrow_type(kinds["item_id"])), ("containment", pa.float64()), ("shingles", pa.int32())])
    found = None
    for items in _passes(benchmark, item_column, item_text, shingle, hashes, pass_bytes):

        def run(batches, items=items):
            return _search(items.value, containment, hashes, out)(batches)

        one = docs.select(id_column, text).mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found


def _holds(items: Broadcast, containment: float, hashes: int) -> Callable[[Column], Column]:
    """Whether a text holds one of the items."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.null()), ("containment", pa.float64()), ("shingles", pa.int32())])

    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        unnamed = copy(items.value)
        unnamed.ids = [None] * len(unnamed.ids)
        rows = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), texts], names=["doc_id", "text"])
        hit = np.zeros(len(texts), bool)
        for pairs in _search(unnamed, containment, hashes, schema)(iter([rows])):
            hit[pairs.column(0).to_numpy()] = True
        return pa.array(hit)

    return holds


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, containment: float = CONTAINMENT, hashes: int = HASHES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs without the rows whose text holds a test item, as ``contaminated`` finds them.

    Each row is judged by its own text: ids are not read, so a row stays whatever others of its id, or without one,
    hold. All columns pass through; rows keep their multiplicity.
    """
    kept = docs
    for items in _passes(benchmark, item_column, item_text, shingle, hashes, pass_bytes):
        kept = kept.where(~_holds(items, containment, hashes)(F.col(text)))
    return kept


def contaminated_sql() -> str:
    """contaminated of the tables, by joining all shingles, as DuckDB SQL for the default parameters."""
    return rf"""
WITH d AS (SELECT doc_id, {T.words_sql("text")} AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, ws, least({SHINGLE}, len(ws)) AS g FROM (SELECT item_id, {T.words_sql("text")} AS ws FROM benchmark WHERE text IS NOT NULL) WHERE len(ws) > 0),
own AS (SELECT DISTINCT item_id, g, unnest(list_transform(range(1, len(ws) - g + 2), lambda k: array_to_string(ws[k : k + g - 1], ' '))) AS s FROM i),
size AS (SELECT item_id, count(*) AS n FROM own GROUP BY item_id),
have AS (SELECT DISTINCT doc_id, g, unnest(list_transform(range(1, len(ws) - g + 2), lambda k: array_to_string(ws[k : k + g - 1], ' '))) AS s FROM d, (SELECT DISTINCT g FROM i) WHERE len(ws) >= g)
SELECT doc_id, item_id, count(*) / any_value(n)::DOUBLE AS containment, any_value(n)::INTEGER AS shingles FROM own JOIN have USING (g, s) JOIN size USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) / any_value(n)::DOUBLE >= {CONTAINMENT}"""
