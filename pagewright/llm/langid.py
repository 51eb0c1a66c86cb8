"""Language identification by word-first backoff.

A known word scores its log frequency in each language. A word never seen in training falls back to its character
n-grams of the greatest length of which any is known: their mean log frequency in each language. Lengths go from
five down to one; n-grams at a word's beginning or end are told from inner ones. A document's score is the sum over
its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrowtext as T

LONGEST, TRAIN_ROWS, LEAST = 5, 10_000, 3
_HEAD, _TAIL = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _starts(data: np.ndarray) -> np.ndarray:
    """Byte positions where characters begin, and the end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def _grams(w: T.Words, chars: np.ndarray, pick: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the picked words, and for each the place of its word in ``pick``."""
    first, last = np.searchsorted(chars, w.start[pick]), np.searchsorted(chars, w.end[pick])
    count = np.maximum(0, last - first - n + 1)
    owner = np.repeat(np.arange(len(pick)), count)
    if not len(owner):
        return np.zeros(0, np.uint64), owner
    begin = np.repeat(first, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    h = T.span_hash(w.prefix, chars[begin], chars[begin + n]) + np.uint64(n)
    h = np.where(begin == first[owner], T.mix(h ^ _HEAD), h)
    return np.where(begin + n == last[owner], T.mix(h ^ _TAIL), h), owner


def _count(langs: list[str]):
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b in T.slices(batch.column(0)):
                w = T.words(batch.column(0).slice(a, b - a))
                chars = _starts(w.data)
                lang = code[a:b][w.row_of()]
                kinds, tongues, hashes, counts = [], [], [], []

                def add(kind, tongue, h, weight=None):
                    for t in np.unique(tongue).tolist():
                        mine = tongue == t
                        if weight is None:
                            u, c = np.unique(h[mine], return_counts=True)
                        else:
                            u, inverse = np.unique(h[mine], return_inverse=True)
                            c = np.bincount(inverse, weight[mine]).astype(np.int64)
                        kinds.append(np.full(len(u), kind, np.int8))
                        tongues.append(np.full(len(u), t, np.int16))
                        hashes.append(u.view(np.int64))
                        counts.append(c)

                key, first, times = np.unique(w.hash + lang.astype(np.uint64), return_index=True, return_counts=True)
                add(0, lang[first], w.hash[first], times)
                add(-1, np.unique(lang), np.zeros(len(np.unique(lang)), np.uint64))  # that there are words
                for n in range(1, LONGEST + 1):
                    h, owner = _grams(w, chars, first, n)
                    add(n, lang[first][owner], h, times[owner])
                if kinds:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kinds, tongues, hashes, [c.astype(np.int64) for c in counts])], names=["kind", "lang", "h", "n"])

    return run


@dataclass
class Languages:
    names: list[str]
    keys: list[np.ndarray]  # words, then n-grams of 1..LONGEST characters
    logs: list[np.ndarray]  # (key, language) log frequencies

    def __post_init__(self):
        self.index = [T.Index(k) for k in self.keys]

    def __getstate__(self):
        return self.names, self.keys, self.logs

    def __setstate__(self, state):
        self.names, self.keys, self.logs = state
        self.__post_init__()

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, languages) log likelihoods, words a row, known words a row."""
        total = np.zeros((len(texts), len(self.names)))
        words, known = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for a, b in T.slices(texts):
            w = T.words(texts.slice(a, b - a))
            if not len(w.hash):
                continue
            _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
            at = self.index[0].find(w.hash[first])
            value = np.zeros((len(first), len(self.names)))
            value[at >= 0] = self.logs[0][at[at >= 0]]
            todo, chars = np.flatnonzero(at < 0), None
            for n in range(LONGEST, 0, -1):
                if not len(todo):
                    break
                chars = _starts(w.data) if chars is None else chars
                h, owner = _grams(w, chars, first[todo], n)
                p = self.index[n].find(h)
                owner, p = owner[p >= 0], p[p >= 0]
                count = np.bincount(owner, minlength=len(todo))
                for j in range(len(self.names)):
                    value[todo, j] = np.bincount(owner, self.logs[n][p, j], minlength=len(todo)) / np.maximum(1, count)
                todo = todo[count == 0]
            live = np.flatnonzero(np.diff(w.rows))
            total[a + live] = np.add.reduceat(value[inverse], w.rows[:-1][live])
            words[a:b] = np.diff(w.rows)
            known[a + live] = np.add.reduceat((at >= 0)[inverse].astype(np.int64), w.rows[:-1][live])
        return total, words, known


def fit(docs: DataFrame, lang: str = "lang", id_column: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, least: int = LEAST) -> Languages:
    """Fitted on about ``train_rows`` documents of known language at most, as many of each language or all that it has,
    picked by a hash of the id.

    A word or n-gram is known if it occurs ``least`` times in them. Frequencies are smoothed by a half. A language whose
    sample has no words is left out.
    """
    marked = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.col(id_column).alias("i"))
    groups = marked.groupBy("l").count().collect()  # a row a language
    langs = sorted(r.l for r in groups)
    share = {r.l: min(1.0, train_rows / len(groups) / r["count"]) for r in groups}
    most = F.create_map(*(F.lit(x) for kv in share.items() for x in (kv[0], int(kv[1] * (1 << 30))))) if share else F.create_map().cast("map<string,int>")
    picked = marked.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < F.try_element_at(most, F.col("l")))
    counts = picked.select("t", "l").mapInArrow(_count(langs), "kind byte, lang short, h long, n long").groupBy("kind", "lang", "h").agg(F.sum("n").alias("n"))
    # bounded: the sample is
    rows = counts.withColumn("all", F.sum("n").over(Window.partitionBy("kind", "h"))).where((F.col("all") >= least) | (F.col("kind") < 0)).select("kind", "lang", "h", "n").toArrow()
    kind, tongue, h, c = (rows.column(i).to_numpy() for i in range(4))
    live = np.isin(np.arange(len(langs)), tongue[kind < 0])
    kept = live[tongue]
    kind, tongue, h, c = kind[kept], (np.cumsum(live) - 1)[tongue[kept]], h[kept], c[kept]
    langs, keys, logs = [x for x, there in zip(langs, live) if there], [], []
    for k in range(LONGEST + 1):
        mine = kind == k
        key, inverse = np.unique(h[mine].view(np.uint64), return_inverse=True)
        table = np.zeros((len(key), len(langs)))
        np.add.at(table, (inverse, tongue[mine]), c[mine])
        sums = table.sum(axis=0)
        keys.append(key)
        logs.append(np.log((table + 0.5) / (sums + 0.5 * max(1, len(key)))).astype(np.float32))
    return Languages(langs, keys, logs)


def identified(model: Languages, text: str | Column, spark) -> Column:
    """A struct: ``lang``, ``margin``, ``words``, ``known``."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, margin double, words long, known long")
    def identify(texts: pa.Array) -> pa.Array:
        m = shared.value
        score, words, known = m.score(texts)
        if not m.names:
            best, margin, none = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.ones(len(texts), bool)
        else:
            best, none = score.argmax(axis=1), words == 0
            order = np.sort(score, axis=1)
            margin = (order[:, -1] - order[:, -2] if len(m.names) > 1 else np.zeros(len(texts))) / np.maximum(1, words)
        names = pa.array([*m.names, None], pa.string()).take(pa.array(np.where(none, len(m.names), best)))
        return pa.StructArray.from_arrays([names, pc.if_else(pa.array(none), None, pa.array(margin)), pa.array(words), pa.array(known)], names=["lang", "margin", "words", "known"])

    return identify(F.col(text) if isinstance(text, str) else text)


def languages(docs: DataFrame, lang: str = "lang", id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, the language ``lang``, the lead a word over the next language ``margin``, ``words`` and how many of
    them are ``known``, for every row of docs.

    Languages that tie give the first in order of name. Null and wordless texts have no language and no margin;
    so has everything where no document of known language is there to learn from. What occurs under ``least`` times in
    the sample is not known, and is scored by shorter n-grams like other unseen words. Repeated rows and null ids are
    scored like others; whole texts count. An empty df gives an empty result.
    """
    model = fit(docs, lang, id_column, text, **options)
    return docs.select(F.col(id_column).alias("doc_id"), identified(model, text, docs.sparkSession).alias("_s")).select("doc_id", "_s.*")
