import math
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import pytest
from conftest_words import words
from pyspark.sql import functions as F

from pagewright.llm import langid as L


def chars(w):
    return w.decode(errors="surrogateescape")


def pieces(w, n):
    s = chars(w)
    return [(s[i : i + n], i == 0, i + n == len(s)) for i in range(len(s) - n + 1)]


class Brute:
    """Word-first backoff over dictionaries."""

    def __init__(self, docs, least):
        self.names = sorted({lang for _, lang in docs})
        tables = [{x: Counter() for x in self.names} for _ in range(L.LONGEST + 1)]
        for text, lang in docs:
            for w in words(text):
                tables[0][lang][w] += 1
                for n in range(1, L.LONGEST + 1):
                    tables[n][lang].update(pieces(w, n))
        self.logs = []
        for t in tables:
            total = sum(t.values(), Counter())
            known = [x for x, c in total.items() if c >= least]
            sums = {lang: sum(t[lang][x] for x in known) for lang in self.names}
            self.logs.append({x: [math.log((t[lang][x] + 0.5) / (sums[lang] + 0.5 * max(1, len(known)))) for lang in self.names] for x in known})

    @lru_cache(None)  # noqa: B019
    def word(self, w):
        if w in self.logs[0]:
            return self.logs[0][w]
        for n in range(L.LONGEST, 0, -1):
            got = [self.logs[n][x] for x in pieces(w, n) if x in self.logs[n]]
            if got:
                return [sum(c) / len(got) for c in zip(*got)]
        return [0.0] * len(self.names)

    def score(self, text):
        every = [self.word(w) for w in words(text)]
        return [sum(c) for c in zip(*every)] if every else [0.0] * len(self.names)


def test_equals_brute_force(load):
    docs = load("documents").where("length(text) < 3000").orderBy("doc_id").limit(120)
    rows = docs.collect()
    train, rest = rows[:60], rows[60:]
    model = L.fit(docs.where(F.col("doc_id").isin([r.doc_id for r in train])), train_rows=10**6, least=2)
    brute = Brute([(r.text, r.lang) for r in train], 2)
    assert model.names == brute.names
    texts = [r.text for r in rest] + ["", None, "zzzqqq ¿x? 東京 -- 12"]
    score, count, known = model.score(pa.array(texts))
    for i, t in enumerate(texts):
        assert score[i].tolist() == pytest.approx(brute.score(t), rel=1e-4, abs=1e-3)
        assert count[i] == len(words(t)) and known[i] == sum(w in brute.logs[0] for w in words(t))


def test_the_whole_query_against_brute_force(load):
    docs = load("documents")
    rows = docs.collect()
    brute = Brute([(r.text, r.lang) for r in rows if r.lang is not None and r.text is not None], L.LEAST)
    got = {r.doc_id: r for r in L.languages(docs).collect()}
    assert len(got) == len(rows) < L.TRAIN_ROWS / len(brute.names)  # the sample is all
    for r in rows:
        w, score, g = words(r.text), brute.score(r.text), got[r.doc_id]
        assert (g.words, g.known) == (len(w), sum(x in brute.logs[0] for x in w))
        if w:
            first, second = sorted(score, reverse=True)[:2]
            assert g.margin == pytest.approx((first - second) / len(w), rel=1e-3, abs=1e-4)
            assert score[brute.names.index(g.lang)] == pytest.approx(first, rel=1e-5)
        else:
            assert g.lang is g.margin is None


def test_each_language_has_its_share_of_the_sample(spark):
    rows = [(i, f"common words of the large language number {i % 50}", "big") for i in range(4000)] + [(9000 + i, "kleine Sprache mit eigenen Worten", "small") for i in range(12)] + [(9998, "hapax legomenon", "once"), (9999, "...", "wordless")]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=300)
    assert model.names == ["big", "once", "small"]
    score, _, known = model.score(pa.array(["eigenen Worten mit", "large language"]))
    assert known.tolist() == [3, 2] and score.argmax(axis=1).tolist() == [2, 0]


def test_held_out_accuracy(load):
    docs = load("documents", "/root/testdata/sf0.01")
    train = docs.where("doc_id % 4 = 0")
    model = L.fit(train)
    got = docs.where("doc_id % 4 <> 0 AND length(text) >= 100").select("lang", L.identified(model, "text", docs.sparkSession).alias("s")).select(F.avg((F.col("lang") == F.col("s.lang")).cast("int"))).first()[0]
    assert got > 0.97


def test_odd_rows(odd, none, spark):
    rows = L.languages(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].lang is by[3].lang is by[4].lang is None and by[2].margin is None and by[3].words == 0
    assert by[5].lang == "en" and by[5].words == 300_000 and by[6].lang == "fr"
    assert L.languages(none).collect() == []
    unknown = L.languages(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang, r.margin) for r in unknown] == [(None, None)]
    tie = L.languages(spark.createDataFrame([(1, "aa aa aa", "b"), (2, "aa aa aa", "a")], "doc_id long, text string, lang string")).collect()
    assert {(r.lang, r.margin) for r in tie} == {("a", 0.0)}
