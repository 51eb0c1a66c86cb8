import corpus_pipeline as P
import pytest
from conftest_words import words

from pagewright.llm import common, decontamination, mixing, ngram_join, sharding, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """(input, output) of each stage."""
    base, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in P.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        out[name] = docs, spark.read.parquet(f"{base}/{name}")
        docs = out[name][1]
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    first = stages["toxicity"][0].columns
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == first
    assert stages["sharding"][1].columns == [*first, "range_id", "shard_id"]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_decision_takes_effect(stages, spark, sf_dir):
    load = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    before, after = stages["toxicity"]
    bad = {r.doc_id for r in toxicity.toxicity(before, load("labels")).where("toxic").collect()}
    assert ids(after) == [i for i in ids(before) if i not in bad]

    before, after = stages["near_duplicates"]
    sets = {}
    for r in before.collect():
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} - {()}
    order, group = sorted(sets), {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for x, a in enumerate(order):
        for b in order[x + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= ngram_join.JACCARD * len(sets[a] | sets[b]) - 1e-12:
                i, j = sorted((find(a), find(b)))
                group[j] = i
    assert ids(after) == [i for i in order if group[i] == i] and len(ids(after)) < len(order)

    before, after = stages["decontamination"]
    items = [words(r.text) for r in load("benchmark").collect()]
    n = decontamination.SHINGLE

    def holds(text):
        w = words(text)
        have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        return any(sum(s in have for s in own) >= decontamination.CONTAINMENT * len(own) for own in ({tuple(v[i : i + n]) for i in range(len(v) - n + 1)} for v in items) if own)

    assert ids(after) == sorted(r.doc_id for r in before.collect() if not holds(r.text))

    before, after = stages["mixing"]
    assert ids(after) == ids(mixing.mix(before, weights=mixing.TARGETS, rest=mixing.REST)) and set(ids(after)) == set(ids(before))

    before, after = stages["sharding"]
    want = {(r.doc_id, r.shard_id) for r in sharding.shard(before, key=sharding.CORPUS_KEY).collect()}
    assert {(r.doc_id, r.shard_id) for r in after.collect()} == want and ids(after) == ids(before)


def test_run_gives_the_last_stage_and_leaves_nothing_else(stages, spark, sf_dir, tmp_path, monkeypatch):
    key = lambda r: (r.doc_id, r.range_id, r.shard_id)
    for module in (P, common):
        monkeypatch.setattr(module, "shared_dir", lambda spark: f"file://{tmp_path}")
    got = P.run(spark, sf_dir)
    assert sorted(map(key, got.collect())) == sorted(map(key, stages["sharding"][1].collect()))
    (left,) = tmp_path.iterdir()
    assert [p.name for p in left.iterdir()] == ["sharding"]


def test_a_folder_is_made_where_none_is_named():
    class Context:
        applicationId, master = "some-application", "local[2]"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    first = common.shared_dir(Session())
    assert first == common.shared_dir(Session()) and first.startswith("file://")
    Context.master = "spark://somewhere"
    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []


def test_null_empty_and_repeated_rows(spark, sf_dir):
    """What each stage's docstring says of them, one stage after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = "a plain note of nothing in particular that nobody else has written"
    odd = [(-1, None, "en", "src1", 0), (-2, "", None, None, 0), (-3, "... !", "en", None, 5), (None, None, None, None, None), (-4, clean, "en", "src1", 9), (-4, clean, "en", "src1", 9), (-5, clean, "de", "src2", 9), (None, clean, "en", "src1", 9)]
    docs = docs.where("doc_id >= 100").unionByName(spark.createDataFrame(odd, docs.schema))
    of = lambda df: sorted(((r.doc_id, r.text) for r in df.where("doc_id < 0 OR doc_id IS NULL").collect()), key=str)
    want = of(docs)
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name == "near_duplicates":
            want = sorted([(-1, None), (-2, ""), (-3, "... !"), (None, None), (-5, clean), (None, clean)], key=str)
        assert (set(of(docs)) if name in ("mixing", "sharding") else of(docs)) == (set(want) if name in ("mixing", "sharding") else want)
