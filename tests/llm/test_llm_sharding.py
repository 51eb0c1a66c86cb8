import oracle
from pyspark.sql import functions as F

from pagewright.llm import sharding


def test_equals_sql(load, sf_dir):
    out = sharding.shard(load("documents"), key=sharding.CORPUS_KEY)
    oracle.assert_same(out, oracle.connect(sf_dir), sharding.shard_sql())
    assert out.select("range_id").distinct().count() > 40


def test_shards_are_partitions_and_ranges_follow_keys(load):
    docs = load("documents")
    out = sharding.shard(docs, key="doc_id", shards=7)
    rows = out.withColumn("p", F.spark_partition_id()).select("doc_id", "text", "range_id", "shard_id", "p").collect()
    assert len(rows) == docs.count()
    assert all(r.p == r.shard_id for r in rows)
    spans = {}
    for r in rows:
        spans.setdefault(r.range_id, []).append(str(r.doc_id))
    ordered = [(min(v), max(v)) for _, v in sorted(spans.items())]
    assert all(a[1] < b[0] for a, b in zip(ordered, ordered[1:]))
    size = {}
    for r in rows:
        size[r.shard_id] = size.get(r.shard_id, 0) + len((r.text or "").encode()) + 1
    longest = max(len((r.text or "").encode()) + 1 for r in rows)
    assert max(size.values()) <= 2.5 * sum(size.values()) / 7 + longest


def test_an_overfull_range_is_subdivided(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("source"), F.lit("x" * 99).alias("text"))
    rows = sharding.shard(docs, shards=10).groupBy("shard_id", "source").count().collect()
    assert len({r.shard_id for r in rows if r.source == "hot"}) >= 8
    assert max(r["count"] for r in rows) <= 600


def test_splitters_fall_inside_a_hot_source(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("source"), F.lit("x" * 99).alias("text"))
    rows = sharding.shard(docs, key=("source", "doc_id"), shards=12).where("source = 'hot'").collect()
    assert len({r.range_id for r in rows}) >= 4
    spans = {}
    for r in rows:
        spans.setdefault(r.range_id, []).append(r.doc_id)
    ordered = [(min(v), max(v)) for _, v in sorted(spans.items())]
    assert all(a[1] < b[0] for a, b in zip(ordered, ordered[1:]))  # by number, not by digits


def test_odd_rows(odd, none):
    out = sharding.shard(odd, shards=4)
    rows = out.collect()
    assert len(rows) == odd.count()
    assert out.columns == [c for c in odd.columns if c not in ("range_id", "shard_id")] + ["range_id", "shard_id"]
    assert all(isinstance(r.range_id, int) and r._parts == "mine-_parts" and r._r == "mine-_r" for r in rows)
    assert len({r.shard_id for r in rows if r.doc_id == 1}) == 1
    assert sharding.shard(none).collect() == sharding.shard(none, key=("source", "doc_id")).collect() == []
    assert sharding.shard(odd, key=("source", "doc_id"), shards=4).count() == odd.count()
