"""URL filtering by the likelihood ratio of two character language models.

One variable-order Markov model is learned from accepted URLs and one from rejected ones. A character's probability
interpolates contexts of five characters down to none: each order's count is smoothed toward the order below, so a
context never seen leaves the shorter one's estimate as it is. A URL's score is the difference of its two log
likelihoods a character; the filter's threshold is calibrated on URLs held out of training.

Counts are of every URL of the table and are kept exactly, a row a context; the model grows with the corpus and is
never in one place. URLs are written in blocks of some hundred thousand characters; each block names the contexts
that occur in it, their counts are summed over all blocks, and each block gets back those it named. Nothing is
broadcast but a bounded number of contexts that very many blocks name, nor sent to the driver but counts and a threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import arrowtext as T
from .common import written

ORDER, STRENGTH, KEPT = 5, 4.0, 0.99
BLOCK_BYTES = 1 << 18
#: A context of so many blocks is hot; as many contexts at most are treated as hot.
HOT_BLOCKS, HOT_CONTEXTS = 1000, 100_000
GROUPS = ("n0", "n1", "n2", "n3")
#: Hosts that hold one of these are the rejected examples of the query.
REJECT_TERMS = ("spam", "pills", "casino", "ads-track", "free-bets", "adult")


def host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _positions(urls: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of (order, context) and of (order, context, character) at each character, and row offsets.

    A line feed ends each URL and is a character; contexts do not reach before a URL's beginning.
    """
    data, offsets = T.raw(pc.binary_join_element_wise(pc.utf8_lower(pc.fill_null(urls, "")), pa.scalar(""), "\n"))
    p = T.prefix_hash(data)
    rows = np.diff(offsets)
    at = np.arange(len(data))
    inside = at - np.repeat(offsets[:-1], rows)
    context, full = np.empty((ORDER + 1, len(data)), np.uint64), np.empty((ORDER + 1, len(data)), np.uint64)
    for k in range(ORDER + 1):
        begin = at - np.minimum(k, inside)
        for out, end, more in ((context, at, 0), (full, at + 1, 1)):
            out[k] = T.mix(T.span_hash(p, begin, end) ^ np.uint64((2 * k + more) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return context, full, offsets


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their block: the partition and a count. The result is written, so it stays."""
    n = TaskContext.get().partitionId() << 32
    for batch in batches:
        for a, b in T.slices(batch.column(1), BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(np.full(b - a, n))], names=[*batch.schema.names, "block"])
            n += 1


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, group, block) to counts by block and context in each group: 2 * rejected + held out, or null for none.

    A block that spans batches or partitions gives a context once for each of its parts.
    """
    for batch in batches:
        block = batch.column(2).to_numpy()
        edge = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
        for a, b in zip(edge[:-1], edge[1:]):
            if a < b:
                group = pc.fill_null(batch.column(1).slice(a, b - a), 4).to_numpy(zero_copy_only=False).astype(np.int64)
                context, full, offsets = _positions(batch.column(0).slice(a, b - a))
                h, at = np.unique(np.concatenate((context.ravel(), full.ravel())), return_inverse=True)
                of = np.tile(np.repeat(group, np.diff(offsets)), 2 * (ORDER + 1))
                n = np.bincount(at * 5 + of, minlength=5 * len(h)).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), block[a])), pa.array(h.view(np.int64)), *(pa.array(n[:, g]) for g in range(4))], names=["block", "h", *GROUPS])


class UrlModel:
    """Counts of contexts, with and without the character that follows, of accepted and of rejected URLs."""

    def __init__(self, keys: np.ndarray, accepted: np.ndarray, rejected: np.ndarray):
        order = np.argsort(keys)
        if (keys[order][1:] == keys[order][:-1]).any():
            raise ValueError("a context has more than one row of counts")
        self.index, self.accepted, self.rejected = T.Index(keys), accepted[order], rejected[order]

    def score(self, urls: pa.Array) -> np.ndarray:
        out = np.zeros(len(urls))
        for a, b in T.slices(urls):
            context, full, offsets = _positions(urls.slice(a, b - a))
            prob = np.full((2, context.shape[1]), 1 / 256)
            for k in range(ORDER + 1):
                c, f = self.index.find(context[k]), self.index.find(full[k])
                for side, counts in enumerate((self.accepted, self.rejected)):
                    seen, followed = np.where(c >= 0, counts[c], 0), np.where(f >= 0, counts[f], 0)
                    prob[side] = (followed + STRENGTH * prob[side]) / (seen + STRENGTH)
            total = np.concatenate(([0.0], np.cumsum(np.log(prob[0]) - np.log(prob[1]))))
            out[a:b] = (total[offsets[1:]] - total[offsets[:-1]]) / np.diff(offsets)
        return out


def _scores(key: pa.DataType):
    def run(urls: pa.Table, contexts: pa.Table) -> pa.Table:
        h, *n = (contexts.column(c).to_numpy() for c in ("h", *GROUPS))
        h, first = np.unique(h, return_index=True)  # the parts of a block each name a context, with the same sums over all blocks
        n = [x[first] for x in n]
        text = urls.column("url").combine_chunks()
        score = UrlModel(h.view(np.uint64), n[0] + n[1], n[2] + n[3]).score(text)
        trial = UrlModel(h.view(np.uint64), n[0], n[2]).score(text)
        return pa.table({"page_id": urls.column("page_id").cast(key), "url": text, "g": urls.column("g"), "score": score, "trial": trial})

    return run


def _given_back(named: DataFrame) -> DataFrame:
    """(block, h) with the sums of the counts of h over all blocks.

    Sums are combined before they are shuffled. Short contexts occur in every block; those that occur in very many are
    few by the number of rows there are, so they are broadcast, and the rest are joined by shuffle.
    """
    sums = written(named.groupBy("h").agg(*(F.sum(g).alias(g) for g in GROUPS), F.count("*").alias("blocks")), "url-counts")
    many = max(HOT_BLOCKS, (sums.agg(F.sum("blocks")).first()[0] or 0) // HOT_CONTEXTS)
    hot = F.broadcast(sums.where(F.col("blocks") > many).drop("blocks"))
    rest = sums.where(F.col("blocks") <= many).drop("blocks")
    mine = named.select("block", "h")
    return mine.join(hot, "h").unionByName(mine.join(hot.select("h"), "h", "left_anti").join(rest, "h"))


def filter_urls(df: DataFrame, rejected: Column, url: str = "url", id_column: str = "page_id", kept: float = KEPT) -> DataFrame:
    """page_id, url, ``score`` (log likelihood of accepted over rejected, a character) and ``keep``, a row of df each.

    ``rejected`` says which URLs are examples of what to reject and which of what to accept (null: of neither).
    Every fifth, by its hash, is held out while the threshold is calibrated: the score that ``kept`` of the accepted
    ones reach, but not above zero. The final counts are of all. Without examples of either side nothing is rejected.

    A null URL has no score and is not kept; an empty one is scored by its end alone. Repeated URLs count as often
    as they occur and score alike; whole URLs count. Null ids pass. An empty df gives an empty result; other columns
    are not read but by ``rejected``.
    """
    held = F.pmod(F.xxhash64(url), F.lit(5)) == 0
    group = F.when(F.col(url).isNotNull(), rejected.cast("int") * 2 + held.cast("int")).cast("byte")
    rows = df.select(F.col(id_column).alias("page_id"), F.col(url).cast("string").alias("url"), group.alias("g"))
    key = rows.schema["page_id"].dataType
    kind = f"page_id {key.simpleString()}, url string, g byte"
    placed = written(rows.where("url is not null").mapInArrow(_place, f"{kind}, block long"), "url-blocks")
    named = placed.select("url", "g", "block").mapInArrow(_contexts, "block long, h long, " + ", ".join(f"{g} long" for g in GROUPS))
    counts = _given_back(written(named, "url-contexts"))
    scored = placed.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_scores(to_arrow_type(key)), f"{kind}, score double, trial double")
    scored = written(scored, "url-scores")
    low = F.percentile_approx(F.when(F.col("g") == 1, F.col("trial")), F.lit(1 - kept), F.lit(10_000))
    good, bad, low = scored.agg(F.count_if(F.col("g") < 2), F.count_if(F.col("g") >= 2), low).first()
    threshold = min(0.0, low if low is not None else 0.0) if good and bad else -float("inf")
    out = scored.select("page_id", "url", "score", (F.col("score") >= F.lit(threshold)).alias("keep"))
    none = rows.where("url is null").select("page_id", "url", F.lit(None).cast("double").alias("score"), F.lit(False).alias("keep"))
    return out.unionByName(none)


def seed_rejects(url: str = "url") -> Column:
    """The query's examples: URLs whose host holds one of REJECT_TERMS."""
    hit = F.lit(False)
    for term in REJECT_TERMS:
        hit = hit | F.contains(host(url), F.lit(term))
    return hit
