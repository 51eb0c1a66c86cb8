import random

import numpy as np
import oracle
import pytest
from conftest_words import words

from pagewright.llm import decontamination as D


def brute(docs, items, n=5, least=0.6):
    out = {}
    for i, (doc, text) in enumerate(docs):
        w = words(text)
        for j, (item, t) in enumerate(items):
            v = words(t)
            g = min(n, len(v))
            if not g:
                continue
            own = {tuple(v[k : k + g]) for k in range(len(v) - g + 1)}
            have = {tuple(w[k : k + g]) for k in range(len(w) - g + 1)}
            share = len(own & have) / len(own)
            if share >= least:
                out[i, j] = (doc, item, round(share, 9), len(own))
    return sorted(out.values(), key=str)


def test_equals_sql(load, sf_dir):
    assert oracle.assert_same(D.contaminated(load("documents"), load("benchmark")), oracle.connect(sf_dir), D.contaminated_sql()) > 0


def test_recall_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda k: " ".join(r.choices(vocabulary, k=k))
    items = [(j, text(r.choice([3, 6, 9, 20, 40, 130]))) for j in range(60)]
    docs = []
    for i in range(150):
        parts = text(r.choice([0, 30, 300, 3000])).split()
        if r.random() < 0.7:
            item = r.choice(items)[1].split()
            keep = item[: max(1, int(len(item) * r.choice([0.5, 0.8, 1.0])))]
            if r.random() < 0.3:
                keep[r.randrange(len(keep))] = "other"
            at = r.randint(0, len(parts))
            parts[at:at] = keep
        docs.append((i, " ".join(parts)))
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((x.doc_id, x.item_id, round(x.containment, 9), x.shingles) for x in got.collect()), key=str)
    want = brute(docs, items)
    assert len(want) > 40 and set(got) <= set(want)
    assert len(got) >= 0.98 * len(want)


def test_passes_give_the_same(load):
    one = D.contaminated(load("documents"), load("benchmark"))
    many = D.contaminated(load("documents"), load("benchmark"), pass_bytes=2000)
    assert sorted(one.collect()) == sorted(many.collect())


def test_long_document_is_searched_whole(spark):
    r = np.random.default_rng(1)
    body = [f"x{v}" for v in r.integers(0, 100_000, 400_000)]
    item = [f"y{v}" for v in range(12)]
    docs = [(i, " ".join(body[:at] + item + body[at:])) for i, at in enumerate((0, 199_993, 400_000))]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string"))
    assert sorted((x.doc_id, x.item_id, x.containment) for x in got.collect()) == [(i, 9, 1.0) for i in range(3)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "words here and there all"), (2, None), (3, ""), (None, "here and there"), (5, "..."), (6, "one"), (6, "one")], "item_id long, text string")


def test_odd_rows(odd, none, items):
    got = sorted(((x.doc_id, x.item_id) for x in D.contaminated(odd, items).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (1, None), (1, None), (None, None), (7, 6), (7, 6)], key=str)
    assert D.contaminated(none, items).collect() == D.contaminated(odd, items.limit(0)).collect() == []
    kept = D.decontaminate(odd, items)
    assert kept.columns == odd.columns and {x._bad for x in kept.collect()} == {"mine-_bad"}
    assert sorted(x.doc_id for x in kept.collect()) == [2, 3, 4, 5, 6]
    assert D.decontaminate(odd, items.limit(0)).count() == odd.count()
    assert D.decontaminate(none, items).collect() == []


def test_rows_are_judged_one_by_one(spark, items):
    rows = [(None, "words here and there all"), (None, "nothing of the kind"), (1, "words here and there all"), (1, "clean of all that"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"pass_bytes": 20}):
        assert sorted(D.decontaminate(df, items, **options).collect(), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
