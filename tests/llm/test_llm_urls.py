import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import urls as U


class Brute:
    """Smoothed variable-order counts in dictionaries."""

    def __init__(self, urls):
        self.context, self.full = Counter(), Counter()
        for u in urls:
            for k, context, c in self.events(u):
                self.context[k, context] += 1
                self.full[k, context, c] += 1

    @staticmethod
    def events(u):
        s = (u.lower() + "\n").encode()
        return [(k, s[max(0, i - k) : i], s[i]) for i in range(len(s)) for k in range(U.ORDER + 1)]

    def log(self, u):
        total, p = 0.0, 1 / 256
        for k, context, c in self.events(u):
            p = 1 / 256 if k == 0 else p
            p = (self.full[k, context, c] + U.STRENGTH * p) / (self.context[k, context] + U.STRENGTH)
            if k == U.ORDER:
                total += math.log(p)
        return total


def made(r, bad):
    word = lambda: "".join(r.choices("abcdeimnorst", k=r.randint(3, 8)))
    return f"http://{r.choice(['casino', 'pills', 'spam']) if bad else word()}-{word()}.example.com/{word()}/{r.randint(1, 999)}"


def test_equals_brute_force():
    r = random.Random(1)
    good, bad = [made(r, False) for _ in range(40)], [made(r, True) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(good + bad), pa.array([0] * 40 + [2] * 20, pa.int8()), pa.array([7] * 60)], names=["url", "g", "block"])
    (counts,) = U._contexts(iter([batch]))
    tests = [made(r, x) for x in (0, 1) * 20] + ["", "x", "http://É.example/日本"]
    a, b = Brute(good), Brute(bad)
    want = [(a.log(u) - b.log(u)) / (len(u.lower().encode()) + 1) for u in tests]
    model = U.UrlModel(counts.column("h").to_numpy().view(np.uint64), counts.column("n0").to_numpy(), counts.column("n2").to_numpy())
    assert model.score(pa.array(tests)).tolist() == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_held_out_accuracy(spark):
    r = random.Random(7)
    rows = [(i, made(r, i % 4 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = [x for x in U.filter_urls(df, F.when(F.col("page_id") < 2000, U.seed_rejects())).collect() if x.page_id >= 2000]
    assert len(got) == 1000
    bad, good = [x for x in got if x.page_id % 4 == 0], [x for x in got if x.page_id % 4]
    assert np.mean([[g.score > b.score for b in bad] for g in good]) > 0.97  # area under the curve
    assert np.mean([x.keep for x in bad]) < 0.2 and np.mean([x.keep for x in good]) > 0.97


def test_blocks_make_no_difference(spark):
    r = random.Random(9)
    df = spark.createDataFrame([(i, made(r, i % 5 == 0)) for i in range(400)], "page_id long, url string")
    score = lambda n: {x.page_id: x.score for x in U.filter_urls(df.repartition(n), U.seed_rejects()).collect()}
    one = score(1)
    assert score(9) == pytest.approx(one)
    a, b = Brute([x.url for x in df.where(~U.seed_rejects()).collect()]), Brute([x.url for x in df.where(U.seed_rejects()).collect()])
    assert one == pytest.approx({x.page_id: (a.log(x.url) - b.log(x.url)) / (len(x.url) + 1) for x in df.collect()})


def test_hot_contexts_are_counted_like_others(spark, monkeypatch):
    r = random.Random(13)
    df = spark.createDataFrame([(i, made(r, i % 5 == 0)) for i in range(300)], "page_id long, url string").repartition(9)
    want = {x.page_id: x.score for x in U.filter_urls(df, U.seed_rejects()).collect()}
    for most in (0, 3):  # all are hot, and those of more than three blocks
        monkeypatch.setattr(U, "HOT_BLOCKS", most)
        assert {x.page_id: x.score for x in U.filter_urls(df, U.seed_rejects()).collect()} == pytest.approx(want)


def test_blocks_that_span_batches(spark):
    r = random.Random(11)
    df = spark.createDataFrame([(i, made(r, i % 5 == 0)) for i in range(400)], "page_id long, url string").repartition(9).cache()
    a, b = Brute([x.url for x in df.where(~U.seed_rejects()).collect()]), Brute([x.url for x in df.where(U.seed_rejects()).collect()])
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = {x.page_id: x.score for x in U.filter_urls(df, U.seed_rejects()).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == pytest.approx({x.page_id: (a.log(x.url) - b.log(x.url)) / (len(x.url) + 1) for x in df.collect()})


def test_repeated_contexts_are_refused():
    with pytest.raises(ValueError):
        U.UrlModel(np.array([3, 5, 3], np.uint64), np.ones(3), np.ones(3))


def test_pages(load):
    pages = load("pages")
    got = U.filter_urls(pages, U.seed_rejects())
    assert got.count() == pages.count() and got.columns == ["page_id", "url", "score", "keep"]


def test_odd_rows(spark):
    rows = [(1, "http://good.example/a"), (1, "http://good.example/a"), (2, None), (None, ""), (3, "http://casino.example/" + "b" * 500_000), (4, "not a url"), (5, "http://casino.example/x")]
    df = spark.createDataFrame([(*x, 1.0, "k") for x in rows], "page_id long, url string, score double, keep string")
    got = U.filter_urls(df, U.seed_rejects()).collect()
    assert len(got) == len(rows)
    assert [(x.score, x.keep) for x in got if x.url is None] == [(None, False)]
    assert all(math.isfinite(x.score) for x in got if x.url is not None)
    assert len({x.score for x in got if x.page_id == 1}) == 1
    assert all(x.keep for x in U.filter_urls(df.where("page_id = 1"), U.seed_rejects()).collect())  # nothing to learn to reject from
    assert U.filter_urls(df.limit(0), U.seed_rejects()).collect() == []
