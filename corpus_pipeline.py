"""From raw documents to sharded training data, in five stages, each written as Parquet and read by the next.

toxicity rejects toxic documents; near_duplicates keeps one document of each group; decontamination drops
documents that hold a benchmark item; mixing repeats documents so that the sources reach their target weights;
sharding range-partitions what there is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import decontamination, mixing, ngram_join, sharding, toxicity
from pagewright.llm.common import delete, scratch, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and wordless texts stay; equal texts are judged alike. Without toxic labels nothing goes."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group the smallest id stays. Null, empty and wordless texts and rows without an id stay; equal rows are
    one document, of which one row stays."""
    return ngram_join.deduplicate(docs).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is judged by its own text; null, empty and wordless texts stay. Without test items nothing goes."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, some more than once; a null source is one of its own; rows of one id are repeated alike."""
    return mixing.mix(docs, weights=mixing.TARGETS, rest=mixing.REST).select(COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; rows of null source come first, and rows of one source and id are together."""
    return sharding.shard(docs, key=sharding.CORPUS_KEY)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: No SQL states a trained classifier or grouped near duplicates; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage needed besides goes when it is written, and so do its predecessor's rows."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if before:
            delete(spark, before)
        before = f"{base}/{name}"
        docs = spark.read.parquet(before)
    return docs
