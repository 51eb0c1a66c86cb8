"""Sharding by sampled splitters.

1. Key, id and size of every record go to a narrow written table; all planning reads that.
2. A record is sampled with probability proportional to its size (1 beyond the sampling step), so the sample's
   weights estimate bytes. Cumulated in key order, they give quantile boundaries: the splitters.
3. Records fall in the range after the last splitter below their key. The exact bytes of each range are summed
   over all records; a range of more than ``slack`` shards' bytes, such as that of one hot key, is subdivided
   evenly by a draw on the id.
4. The records move once, straight to the partition of their shard.

What is held on the driver is one splitter and one size a shard.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from .common import draw, draw_sql, fresh, text_bytes, without, written

SHARDS, SHARD_BYTES, OVERSAMPLE, SLACK = 64, 1 << 30, 64, 1.25
#: Splitters held in memory; beyond it, ask for larger shards.
MOST_SHARDS = 1_000_000
#: The key of the query and the pipeline: a source may be a third of all rows, and its documents are in order of id.
CORPUS_KEY = ("source", "doc_id")


def sort_key(df: DataFrame, key: str | Sequence[str]) -> Column:
    """A string in the order of the key; of several columns, in the order of the first, then the next. Integers of a
    key of several are padded, so that those from zero up are in their own order; nulls are empty strings."""
    if isinstance(key, str):
        return F.coalesce(F.col(key).cast("string"), F.lit(""))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("\x01", *(F.lpad(plain(c), 20, "0") if isinstance(df.schema[c].dataType, IntegralType) else plain(c) for c in key))


def shard(df: DataFrame, key: str | Sequence[str] = "source", id_column: str = "doc_id", text: str = "text", shards: int = SHARDS, shard_bytes: int = SHARD_BYTES, oversample: int = OVERSAMPLE, slack: float = SLACK, seed: str = "shard") -> DataFrame:
    """df with ``range_id`` and ``shard_id`` (both 0-based ints), each shard in a partition of its own.

    There are ``shards`` shards to aim at, or more if one would exceed ``shard_bytes``. With a key of several columns,
    such as source and id, splitters fall inside a hot source. Every row is kept, repeated
    rows each. A null key counts as the empty string and comes first; a null id draws as the empty string; a null
    or empty text weighs one byte; one long text is never split. Rows with equal key and id land together. An empty
    df gives an empty result. Columns named range_id or shard_id are replaced; others pass through.
    """
    spark = df.sparkSession
    base = without(df, ["range_id", "shard_id"])
    by = sort_key(df, key)
    meta = written(df.select(by.alias("k"), F.col(id_column).cast("string").alias("id"), text_bytes(text).alias("b")), "shard-meta")
    total = meta.agg(F.sum("b")).first()[0]
    if total is None:
        return base.withColumns({"range_id": F.lit(None).cast("int"), "shard_id": F.lit(None).cast("int")})
    n = max(shards, math.ceil(total / shard_bytes))
    if n > MOST_SHARDS:
        raise ValueError(f"{n} shards of {shard_bytes} bytes; raise shard_bytes")
    width, rate = max(1, total // n), oversample * n / total
    step = math.ceil(1 / rate)
    by_key = Window.orderBy("k")
    cum = F.sum("w").over(by_key.rowsBetween(Window.unboundedPreceding, 0))
    splitters = (  # one row a sampled key: at most the sample, which grows with the number of shards alone
        meta.where(draw(F.col("id"), seed) < F.col("b") * F.lit(rate))
        .groupBy("k").agg(F.sum(F.greatest("b", F.lit(step))).alias("w"))
        .select("k", F.floor(cum / width).alias("to"), F.floor((cum - F.col("w")) / width).alias("at"))
        .where("to > at").orderBy("k").select("k")
    )
    bounds = [r.k for r in splitters.toLocalIterator()]
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(k)
        return pd.Series(np.searchsorted(np.array(shared.value, object), np.array(distinct, object))[codes].astype("int32"))

    sizes = sorted(meta.select(range_of("k").alias("r"), "b").groupBy("r").agg(F.sum("b").alias("b")).collect())
    plan, at = [], 0
    for r, b in sizes:
        parts = math.ceil(b / width) if b > slack * width else 1
        plan.append((r, parts, at))
        at += parts
    r, parts, first = fresh(base, "_r", "_parts", "_first")
    ranges = F.broadcast(spark.createDataFrame(plan, f"{r} int, {parts} int, {first} int"))  # a row a range
    out = base.withColumn("range_id", range_of(by)).join(ranges, F.col("range_id") == F.col(r))
    sub = F.floor(draw(F.col(id_column), seed + "-part") * F.col(parts))
    out = out.withColumn("shard_id", (F.col(first) + sub).cast("int")).drop(r, parts, first)
    return out.repartitionById(at, F.col("shard_id"))


def shard_sql(source: str = "documents", columns: str = "doc_id, text, lang, source, n_chars", seed: str = "shard") -> str:
    """The same as DuckDB SQL for the key (source, doc_id), id doc_id and the default parameters."""
    return f"""
WITH meta AS (SELECT {columns}, coalesce(source, '') || chr(1) || lpad(coalesce(doc_id::VARCHAR, ''), 20, '0') AS k, coalesce(strlen(text), 0) + 1 AS b FROM {source}),
t AS (SELECT sum(b)::BIGINT AS total, greatest({SHARDS}, ceil(sum(b) / {SHARD_BYTES}.0))::BIGINT AS n FROM meta),
p AS (SELECT greatest(1, total // n) AS width, {OVERSAMPLE}.0::DOUBLE * n / total AS rate, ceil(total / ({OVERSAMPLE}.0::DOUBLE * n))::BIGINT AS step FROM t),
s AS (SELECT k, sum(greatest(b, step))::BIGINT AS w FROM meta, p WHERE {draw_sql("doc_id", seed)} < b * rate GROUP BY k),
c AS (SELECT k, w, sum(w) OVER (ORDER BY k)::BIGINT AS cum FROM s),
splits AS (SELECT k FROM c, p WHERE cum // width > (cum - w) // width),
numbered AS (SELECT k AS after, row_number() OVER (ORDER BY k) AS r FROM splits UNION ALL SELECT NULL, 0),
keys AS (SELECT g.k, g.b, coalesce(n.r, 0) AS r FROM (SELECT k, sum(b) AS b FROM meta GROUP BY k) g ASOF LEFT JOIN (SELECT * FROM numbered WHERE r > 0) n ON g.k > n.after),
sizes AS (SELECT r, sum(b) AS b FROM keys GROUP BY r),
parts AS (SELECT r, CASE WHEN b > {SLACK} * width THEN ceil(b / width::DOUBLE) ELSE 1 END::BIGINT AS parts FROM sizes, p),
plan AS (SELECT r, parts, sum(parts) OVER (ORDER BY r)::BIGINT - parts AS first FROM parts)
SELECT {columns}, r::INTEGER AS range_id, (first + floor({draw_sql("doc_id", seed + "-part")} * parts))::INTEGER AS shard_id
FROM meta JOIN keys USING (k) JOIN plan USING (r)"""
