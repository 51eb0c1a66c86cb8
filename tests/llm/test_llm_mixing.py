import math
import random

import oracle
import pytest

from pagewright.llm import mixing


def test_equals_sql(load, sf_dir):
    oracle.assert_same(mixing.mix(load("documents"), weights=mixing.TARGETS, rest=mixing.REST), oracle.connect(sf_dir), mixing.mix_sql())


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_targets_clamp_a_source_and_lose_no_document(load, d):
    docs = load("documents", d)
    plan = {r.s: r for r in mixing.allocation(docs, weights=mixing.TARGETS, rest=mixing.REST).collect()}
    assert plan["src1"].epochs == mixing.MAX_EPOCHS and all(1 <= r.epochs <= mixing.MAX_EPOCHS for r in plan.values())
    free = [r for r in plan.values() if r.epochs < mixing.MAX_EPOCHS]
    levels = [r.epochs * r.bytes / r.weight for r in free]
    assert max(levels) == pytest.approx(min(levels))  # what is not clamped shares in proportion to weight
    assert levels[0] > max(r.bytes / r.weight for r in plan.values())  # and has taken the excess


def filled(sizes, weights, cap, budget):
    """Epochs by clamping and redistributing until nothing exceeds its cap."""
    clamped, live = {}, {s for s in sizes if weights.get(s, 0) > 0}
    while True:
        left = budget - sum(clamped[s] * sizes[s] for s in clamped)
        free = live - set(clamped)
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            return {s: clamped.get(s, left * weights[s] / total / sizes[s] if s in free else 0.0) for s in sizes}
        clamped |= dict.fromkeys(over, cap)


@pytest.mark.parametrize("seed", range(4))
def test_equals_repeated_redistribution(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.randint(2, 4000) for i in range(8)}
    weights = {f"s{i}": r.choice([0, 0.1, 1, 1, 5]) for i in range(8)} | {"s0": 1.0}
    df = spark.createDataFrame([(i, s, "x" * (n - 1)) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, text string")
    budget = int(sum(n for s, n in sizes.items() if weights[s]) * r.uniform(0.3, 3.9))
    got = {x.s: x.epochs for x in mixing.allocation(df, weights=weights, max_epochs=4.0, budget=budget).collect()}
    want = filled(sizes, weights, 4.0, budget)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-12) for s in want)


def test_repetitions(spark):
    df = spark.createDataFrame([(i, "a" if i < 1000 else "b", "x" * 9) for i in range(5000)], "doc_id long, source string, text string")
    rows = mixing.mix(df, weights={"a": 1.0, "b": 1.0}, max_epochs=2.5, budget=100_000).groupBy("doc_id").count().collect()
    n = {r.doc_id: r["count"] for r in rows}
    assert {n[i] for i in range(1000)} == {2, 3}  # two and a half epochs
    assert abs(sum(n[i] for i in range(1000)) - 2500) < 100
    assert {n.get(i, 0) for i in range(1000, 5000)} == {1, 2}  # what a cannot take: 75,000 of 40,000 bytes
    again = mixing.mix(df.repartition(7), weights={"a": 1.0, "b": 1.0}, max_epochs=2.5, budget=100_000).groupBy("doc_id").count().collect()
    assert n == {r.doc_id: r["count"] for r in again}


def test_odd_rows(odd, none):
    out = mixing.mix(odd, max_epochs=3.0)
    rows = out.collect()
    assert out.columns == [c for c in odd.columns if c != "repetition"] + ["repetition"]
    assert all(r._s == "mine-_s" and r._e == "mine-_e" and r._n == "mine-_n" for r in rows)
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    assert sum(r.doc_id == 1 and r.repetition == 1 for r in rows) == 2
    assert all(r.repetition <= 3 for r in rows)
    assert mixing.mix(none).collect() == []
    assert mixing.mix(odd, weights={}).collect() == []
    assert {r.doc_id for r in mixing.mix(odd, weights={"b": 0.5}, rest=0.5).collect()} == {1, 2, 3, 4, 5, 6, 7, None}
