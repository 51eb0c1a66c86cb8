from functools import lru_cache

import conftest_words
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import arrowtext as T
from pagewright.llm import toxicity as X
from pagewright.llm.linear import Ftrl

D, BIG = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def split(load):
    docs, labels = load("documents", D), load("labels", D)
    return docs, labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")


@pytest.fixture(scope="module")
def chain(split):
    return X.fit(split[0], split[1])


def test_scores_follow_the_chain(chain):
    texts = ["You worthless idiot, go away", "a quiet day in the garden", "", None, "idiot idiot idiot"]
    size = 1 << X.BITS
    got = chain.score(pa.array(texts))
    for i, (at, _) in enumerate(X._features(pa.array(texts))):
        earlier = []
        for j, w in enumerate(chain.weights):
            logit = w[at].sum() + w[-1] + sum(p * v for p, v in zip(earlier, w[size:-1]))
            earlier.append(1 / (1 + np.exp(-logit)))
            assert got[i, j] == pytest.approx(earlier[-1])
    assert len(chain.weights[-1]) == size + len(chain.names)  # words, earlier categories, bias


def plain_ftrl(rows, y, size, l1, epochs):
    """FTRL-Proximal by dictionaries, rows in the order of the seeded permutations."""
    z, n, rng = {}, {}, np.random.default_rng(0)

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((1.0 + n.get(i, 0.0) ** 0.5) / 0.5 + 1.0)

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            w = {i: weight(i) for i in rows[r]}
            p = 1 / (1 + np.exp(-min(35.0, max(-35.0, sum(w[i] * x for i, x in rows[r].items())))))
            for i, x in rows[r].items():
                g, old = (p - y[r]) * x, n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - old**0.5) / 0.5 * w[i]
    return {i: weight(i) for i in z}


@lru_cache(None)
def plain_word(w):
    """Coordinates of a word by its definition: the word, and its beginnings if it is longer."""
    spelt = [(w, 0), *((w[:k], k) for k in X.STEMS if len(w) > k)]
    hashes = [(T.words(pa.array([t])).hash, k) for t, k in spelt]
    return frozenset(int((T.mix(h + np.uint64(k)) if k else h)[0] >> np.uint64(64 - X.BITS)) for h, k in hashes)


def plain_words(text):
    return frozenset().union(*map(plain_word, {b.decode() for b in conftest_words.words(text)}))


def test_the_whole_query_against_brute_force(load):
    """Folds, weak labels, weights, threshold and scores, without the library's training or features."""
    docs, labels = load("documents"), load("labels")
    texts, size = {r.doc_id: r.text for r in docs.collect()}, 1 << X.BITS
    mark = labels.where("toxic is not null").select("doc_id", "toxic", F.expr("pmod(xxhash64(doc_id), 1073741824)").alias("h")).collect()
    train, seen = [], set()
    for h, y, i in sorted((r.h, r.toxic, r.doc_id) for r in mark if r.doc_id in texts):
        own = frozenset(plain_words(texts[i]))
        held = tuple(bool({w.decode() for w in conftest_words.words(texts[i])} & set(s)) for s in X.CATEGORIES.values())
        if (own, held) not in seen:
            seen.add((own, held))
            train.append((h, y, own, held))
    l1 = max(X.LEAST_L1, X.L1 * len(train) / X.TRAIN_ROWS)
    names, models, before = [], [], [[] for _ in train]
    for j, name in enumerate([*X.CATEGORIES, "toxic"]):
        t = [y * (held[j] if j < len(held) else 1) for _, y, _, held in train]
        if not any(t):
            continue
        k = len(names)
        rows = [dict.fromkeys(sorted(own), 1.0) | {size + m: p for m, p in enumerate(b)} | {size + k: 1.0} for (_, _, own, _), b in zip(train, before)]
        fold = [h % X.FOLDS for h, *_ in train]
        outside = [0.0] * len(train)
        for f in [*range(X.FOLDS), None]:
            inside = [i for i in range(len(train)) if fold[i] != f]
            w = plain_ftrl([rows[i] for i in inside], [t[i] for i in inside], size + k, l1, X.EPOCHS)
            if f is None:
                models.append(w)
            for i in range(len(train)):
                if fold[i] == f:
                    outside[i] = 1 / (1 + np.exp(-sum(w.get(c, 0.0) * x for c, x in rows[i].items())))
        names.append(name)
        before = [[*b, p] for b, p in zip(before, outside)]
    got = {r.doc_id: r for r in X.toxicity(docs, labels).collect()}
    assert set(got) == set(texts) and "toxic" in names
    for i, text in texts.items():
        earlier = []
        for k, w in enumerate(models):
            logit = sum(w.get(c, 0.0) for c in plain_words(text)) + sum(w.get(size + m, 0.0) * p for m, p in enumerate(earlier)) + w.get(size + k, 0.0)
            earlier.append(1 / (1 + np.exp(-logit)))
        assert [got[i][f"p_{n}"] for n in names] == pytest.approx(earlier, abs=1e-9)


def test_seeds_are_whole_words():
    seeds = [T.words(pa.array(list(v))).hash for v in X.CATEGORIES.values()]
    held = [r[1].tolist() for r in X._features(pa.array(["a worthy cause", "she disguised it", "garbanzo", "worthwhile", "Worthless!", "fool, scum"]), seeds)]
    assert held == [[0, 0]] * 4 + [[0, 1], [1, 1]]


def test_earlier_probabilities_are_out_of_fold(split, monkeypatch):
    fitted, asked = [], []
    fit, predict = Ftrl.fit, Ftrl.predict

    def fit_(self, rows, *a, **k):
        fitted.append((self, {tuple(r[0][:50]) for r in rows}))
        return fit(self, rows, *a, **k)

    def predict_(self, rows, **k):
        asked.append((self, {tuple(r[0][:50]) for r in rows}))
        return predict(self, rows, **k)

    monkeypatch.setattr(Ftrl, "fit", fit_)
    monkeypatch.setattr(Ftrl, "predict", predict_)
    X.train(*X.sample(split[0], split[1], train_rows=150), epochs=1)
    assert asked
    for model, rows in asked:
        seen = next(r for m, r in fitted if m is model)
        assert rows and len(rows & seen) <= 0.02 * len(rows)


def test_held_out_accuracy(load):
    train = load("labels", BIG).where("doc_id % 3 <> 0")
    docs, held = load("documents", BIG), load("labels", BIG).where("doc_id % 3 = 0")
    chain = X.fit(docs, train)
    rows = docs.join(held, "doc_id").select(docs.doc_id, "toxic", X.scored(chain, "text", docs.sparkSession).alias("s")).select("doc_id", "toxic", "s.toxic").toDF("doc_id", "label", "found").collect()
    toxic, clean = [r.found for r in rows if r.label], [r.found for r in rows if not r.label]
    assert len(toxic) > 5
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01


def test_reject_keeps_the_rest_whole(split, chain):
    docs, train, _ = split
    kept = X.reject_toxic(docs, train)
    assert kept.columns == docs.columns
    found = {r.doc_id for r in X.toxicity(docs, train).where("toxic").collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - found


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (5, 0, 0), (6, 1, 0), (7, 1, 0), (7, 1, 1), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    rows = X.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.p_toxic <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].p_toxic == by[3].p_toxic == by[4].p_toxic
    assert not (by[2].toxic or by[3].toxic or by[4].toxic)
    kept = X.reject_toxic(odd, labels)
    assert kept.columns == odd.columns
    assert kept.count() == sum(not r.toxic for r in rows)
    assert {r._toxicity for r in X.reject_toxic(odd, labels.where("toxic = 0")).collect()} == {"mine-_toxicity"}
    assert not any(r.toxic for r in X.toxicity(odd, labels.where("toxic = 0")).collect())
    assert X.reject_toxic(odd, labels.limit(0)).count() == odd.count()
    assert X.toxicity(none, labels).collect() == X.reject_toxic(none, labels).collect() == []
