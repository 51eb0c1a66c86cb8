import os
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import arrowtext as T
from pagewright.llm import linear
from pagewright.llm import quality as Q
from pagewright.llm.common import shared_dir
from pagewright.llm.linear import Ftrl


def test_updates_equal_the_published_rule():
    """Against the per-coordinate algorithm, a coordinate at a time."""
    rng = np.random.default_rng(2)
    rows = [(rng.choice(20, 5, replace=False), rng.random(5)) for _ in range(200)]
    y = (rng.random(200) < 0.4).astype(float)
    a, b, l1, l2 = 0.5, 1.0, 0.5, 1.0
    model = Ftrl(20, a, b, l1, l2)
    z, n = [0.0] * 20, [0.0] * 20
    for (at, x), t in zip(rows, y):
        model.update(at, x, t)
        w = {}
        for i in at.tolist():
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((b + n[i] ** 0.5) / a + l2)
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at.tolist(), x))))
        for i, v in zip(at.tolist(), x):
            g = (p - t) * v
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a
            z[i] += g - s * w[i]
            n[i] += g * g
    assert model.z[:20].tolist() == pytest.approx(z) and model.n[:20].tolist() == pytest.approx(n)


def test_scores_are_sparse_dot_products():
    rng = np.random.default_rng(1)
    model = Q.Quality(rng.normal(size=(1 << Q.BITS) + 1), 0.5)
    texts = pa.array(["Some words, some WORDS; and more!", "x", "", None, "été " * 3000])
    want = [1 / (1 + np.exp(-(v @ model.weights[at] + model.weights[-1]))) for at, v in Q._features(texts)]
    assert model.score(texts).tolist() == pytest.approx(want)
    assert len(set(model.score(texts)[2:4])) == 1


def plain_tokens(text):
    return [b.decode() for b in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~\x7f]+", (text or "").encode())]


@lru_cache(None)
def hashed(token):
    return T.tokens(pa.array([token])).hash[0]


@lru_cache(None)
def coordinate(*tokens):
    h = hashed(tokens[0]) if len(tokens) == 1 else T.shingles(np.array([hashed(t) for t in tokens]), np.array([0, 2]), 2)[0][0]
    return int(h >> np.uint64(64 - Q.BITS))


def plain_features(text):
    t = plain_tokens(text)
    every = [coordinate(x) for x in t] + [coordinate(*p) for p in zip(t, t[1:])]
    return {c: n * Q.SCALE / max(1, len(every)) for c, n in Counter(every).items()}


def plain_ftrl(rows, y, epochs, alpha=1.0, beta=1.0, l1=0.3, l2=0.1):
    z, n, rng, bias = {}, {}, np.random.default_rng(0), 1 << Q.BITS

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            row = rows[r] | {bias: 1.0}
            w = {i: weight(i) for i in row}
            p = 1 / (1 + np.exp(-min(35.0, max(-35.0, sum(w[i] * x for i, x in row.items())))))
            for i, x in row.items():
                g, old = (p - y[r]) * x, n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - old**0.5) / alpha * w[i]
    w = {i: weight(i) for i in z}
    return lambda x: 1 / (1 + np.exp(-(sum(w.get(i, 0.0) * v for i, v in x.items()) + w.get(bias, 0.0))))


def test_the_whole_query_against_brute_force(load):
    """Sample, weights, threshold, scores and verdicts, without the library's training or features."""
    docs, labels = load("documents"), load("labels")
    x = {r.doc_id: plain_features(r.text) for r in docs.collect()}
    mark = labels.where("quality is not null").select("doc_id", "quality", F.expr("pmod(xxhash64(doc_id), 1073741824)").alias("h")).collect()
    train, seen = [], set()
    for h, y, i in sorted((r.h, r.quality, r.doc_id) for r in mark if r.doc_id in x):
        if frozenset(x[i].items()) not in seen:
            seen.add(frozenset(x[i].items()))
            train.append((h, y, {c: float(np.float32(v)) for c, v in sorted(x[i].items())}))
    inside, held = [r for r in train if r[0] % 5], [r for r in train if r[0] % 5 == 0 and r[1]]
    trial = plain_ftrl([r[2] for r in inside], [r[1] for r in inside], Q.EPOCHS)
    threshold = min(0.5, float(np.quantile([trial(r[2]) for r in held], 1 - Q.KEPT))) if held else 0.5
    final = plain_ftrl([r[2] for r in train], [r[1] for r in train], Q.EPOCHS)
    got = {r.doc_id: r for r in Q.quality(docs, labels).collect()}
    assert got.keys() == x.keys()
    for i, r in got.items():
        assert r.score == pytest.approx(final(x[i]), abs=1e-6)
        assert abs(r.score - threshold) < 1e-6 or r.keep == (r.score >= threshold)


def in_blocks(texts, marks, blocks, epochs=Q.EPOCHS):
    """Weights and threshold by dictionaries: every labelled text, a block of hashes after another. texts: (id, text)
    rows; marks: (label, hash) by id."""
    rows, seen = [], set()
    for h, y, f in sorted(((marks[i][1], marks[i][0], plain_features(t)) for i, t in texts if i in marks), key=lambda r: r[:2]):
        if frozenset(f.items()) not in seen:
            seen.add(frozenset(f.items()))
            rows.append((h, y, {c: float(np.float32(v)) for c, v in sorted(f.items())}))
    models = []
    for part in ([r for r in rows if r[0] % 5], rows):
        model = Ftrl(1 << Q.BITS, alpha=1.0, l1=0.3, l2=0.1)
        rng = np.random.default_rng(0)
        for _ in range(epochs):
            for b in range(blocks):
                block = [r for r in part if r[0] * blocks >> 30 == b]
                for j in rng.permutation(len(block)):
                    f = block[j][2]
                    model.update(np.array([*f, 1 << Q.BITS]), np.array([*f.values(), 1.0]), block[j][1])
        models.append(model.weights())
    p = [1 / (1 + np.exp(-(sum(models[0][c] * v for c, v in f.items()) + models[0][-1]))) for h, y, f in rows if h % 5 == 0 and y]
    return models[1], min(0.5, float(np.quantile(p, 1 - Q.KEPT))), len(rows)


def marked(labels):
    """An id's largest label, and its hash."""
    rows = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y")).select("doc_id", "y", F.expr("pmod(xxhash64(doc_id), 1073741824)")).collect()
    return {i: (y, h) for i, y, h in rows}


def test_every_labelled_document_counts(spark):
    """More of them than one block holds, each with a word of its own; those that are bad by a word that few share."""
    n = 7000
    texts = [(i, f"w{i} says {'rubbish' if i % 50 == 7 else 'sense'} to {i % 13}") for i in range(n)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 50 != 7)) for i in range(n)], "doc_id long, quality int")
    weights, threshold, count = in_blocks(texts, marked(labels), 2)
    model = Q.fit(docs, labels)
    assert count == n
    assert model.weights == pytest.approx(weights, abs=1e-9) and model.threshold == pytest.approx(threshold, abs=1e-9)


def test_blocks_and_passes(load, odd, monkeypatch):
    """Many blocks and labels in several passes, with repeated rows, texts that are alike in several blocks, long ones
    and empty ones; nothing is left in the shared folder."""
    docs, labels = load("documents"), load("labels").select("doc_id", "quality")
    odd = odd.select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text")
    more = docs.select(F.col("doc_id") + 2 * 10**6, "text").toDF("doc_id", "text")
    docs = docs.select("doc_id", "text").unionByName(odd).unionByName(more)
    labels = labels.union(odd.select("doc_id", F.lit(1))).union(odd.select("doc_id", F.lit(0))).union(more.select("doc_id", (F.col("doc_id") % 7 > 0).cast("int")))
    texts = [tuple(r) for r in docs.collect()]
    marks, once = marked(labels), Q.fit(docs, labels)
    here = sum(i in marks for i, _ in texts)
    monkeypatch.setattr(linear, "BLOCK", 40)
    monkeypatch.setattr(linear, "BROADCAST_BYTES", 2000)
    blocks = -(-here // 40)
    weights, threshold, count = in_blocks(texts, marks, blocks)
    before = set(os.listdir(shared_dir(docs.sparkSession).removeprefix("file://")))
    model = Q.fit(docs.repartition(7), labels)
    assert blocks > 5 and count < here
    assert model.weights == pytest.approx(weights, abs=1e-9) and model.threshold == pytest.approx(threshold, abs=1e-9)
    assert set(os.listdir(shared_dir(docs.sparkSession).removeprefix("file://"))) == before
    monkeypatch.setattr(linear, "BLOCK", 4096)
    model = Q.fit(docs, labels)  # passes alone change nothing
    assert model.weights.tolist() == once.weights.tolist() and model.threshold == once.threshold


def test_packed_features_come_back():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 3000):
        at, x = np.sort(rng.choice(1 << Q.BITS, n, replace=False)), rng.random(n)
        got = linear.unpack(n, linear.pack(at, x))
        assert got[0].tolist() == at.tolist() and got[1].tolist() == x.astype(np.float32).tolist()


def test_held_out_accuracy(load):
    d = "/root/testdata/sf0.01"
    docs, labels = load("documents", d), load("labels", d)
    model = Q.fit(docs, labels.where("doc_id % 3 <> 0"))
    got = docs.join(labels.where("doc_id % 3 = 0"), "doc_id").select("quality", Q.scored(model, "text", docs.sparkSession).alias("s")).select("quality", "s.*")
    rows = got.collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert len(bad) > 5
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95  # area under the curve
    assert np.mean([r.keep for r in rows if r.quality]) > 0.98


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (5, 0, 0), (6, 1, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    rows = Q.quality(odd, labels).collect()
    assert len(rows) == odd.count() and sorted(map(str, rows)) == sorted(map(str, Q.quality(odd.repartition(3), labels).collect()))
    by = {r.doc_id: r for r in rows}
    assert by[2].score == by[3].score and all(0 <= r.score <= 1 for r in rows)
    assert {(r.score, r.keep) for r in Q.quality(odd, labels.limit(0)).collect()} == {(0.5, True)}
    assert Q.quality(none, labels).collect() == []
