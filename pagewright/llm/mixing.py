"""Mixing sources to target weights by capped water-filling.

Each source has a target weight. Filling all in proportion to weight, a source that would be read more than
``max_epochs`` times is clamped there and its excess goes to the others in proportion to their weights, until
nothing exceeds its cap. Ordered by cap over weight, the clamped sources are a prefix, so the fixed point of that
redistribution has a closed form: running sums over the sources.

A source then has a number of epochs e; each of its records is repeated floor(e) times, and once more if its
seeded draw is below the fraction.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import draw, draw_sql, fresh, small, text_bytes, without, written

MAX_EPOCHS, TEMPERATURE = 4.0, 0.9
#: The query's and the pipeline's target weights: of two sources, and what all others have together. The second is a
#: small source that can't fill its share, so that it is clamped and the others take its excess.
TARGETS, REST = {"src0": 0.24, "src1": 0.20}, 0.56


def allocation(df: DataFrame, source: str = "source", text: str = "text", weights: Mapping[str, float] | None = None, rest: float = 0.0, temperature: float = TEMPERATURE, max_epochs: float = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """A row a source: ``s``, ``bytes``, ``weight`` (summing to 1), ``epochs``.

    Sizes are bytes of text plus one a record; a null source is a source of its own, named ''. Without ``weights``
    a source weighs its size to the power ``temperature``; with them, the sources not named share the weight ``rest``
    in proportion to that power, and weigh nothing and get no epochs if it is 0. Without ``budget`` (bytes to fill), it is the least at which no source of positive weight would fall below one epoch. A budget
    beyond all caps leaves every source at its cap. Ties in cap over weight are clamped together.
    """
    got = df.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s")).agg(F.sum(text_bytes(text)).cast("double").alias("bytes"))
    every = Window.partitionBy()  # over the sources: a row each
    raw = F.pow("bytes", F.lit(temperature))
    if weights is not None:
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        named = F.try_element_at(F.create_map(*pairs), F.col("s")) if pairs else F.lit(None).cast("double")
        got = got.withColumn("named", named).withColumn("size", F.when(F.col("named").isNull(), raw))
        raw = F.coalesce("named", F.lit(float(rest)) * F.col("size") / F.sum("size").over(every))
    w = got.withColumn("raw", raw).withColumn("weight", F.when(F.sum("raw").over(every) > 0, F.col("raw") / F.sum("raw").over(every)).otherwise(0.0)).select("s", "bytes", "weight")
    live = w.where("weight > 0")
    live = live.withColumn("cap", F.col("bytes") * F.lit(max_epochs)).withColumn("fill", F.lit(float(budget)) if budget is not None else F.max(F.col("bytes") / F.col("weight")).over(every))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumns({"caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    live = live.withColumn("level", (F.col("fill") - F.col("caps")) / F.col("left"))
    live = live.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("s")))).over(every)
    live = live.withColumn("level", level).withColumn("epochs", F.least(F.lit(max_epochs), F.coalesce(F.col("level") * F.col("weight") / F.col("bytes"), F.lit(max_epochs))))
    return live.select("s", "bytes", "weight", "epochs").unionByName(w.where("weight <= 0").select("s", "bytes", "weight", F.lit(0.0).alias("epochs")))


def mix(df: DataFrame, source: str = "source", id_column: str = "doc_id", text: str = "text", seed: str = "mix", **options) -> DataFrame:
    """The rows of df, each as often as its source's epochs and its draw say, numbered by ``repetition`` from 1.

    A null id draws as the empty string; rows with equal ids draw alike; a null or empty text counts one byte. An
    empty df gives an empty result. A column named repetition is replaced; others pass through.
    """
    base = without(df, ["repetition"])
    s, e, n = fresh(base, "_s", "_e", "_n")
    plan = written(allocation(base, source, text, **options).select(F.col("s").alias(s), F.col("epochs").alias(e)), "mix-plan")
    out = base.join(small(plan), F.coalesce(F.col(source).cast("string"), F.lit("")) == F.col(s))
    whole = F.floor(e)
    copies = (whole + F.when(draw(F.col(id_column), seed) < F.col(e) - whole, 1).otherwise(0)).cast("int")
    out = out.withColumn(n, copies).where(F.col(n) > 0)
    return out.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.col(n)))).drop(s, e, n)


def mix_sql(columns: str = "doc_id, text, lang, source, n_chars", seed: str = "mix") -> str:
    """The same as DuckDB SQL, for the weights TARGETS and REST and the default parameters otherwise."""
    named = " ".join(f"WHEN '{s}' THEN {w}::DOUBLE" for s, w in TARGETS.items())
    return f"""
WITH w0 AS (SELECT coalesce(source, '') AS s, sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS bytes FROM documents GROUP BY 1),
w1 AS (SELECT s, bytes, CASE s {named} END AS named, CASE WHEN named IS NULL THEN pow(bytes, {TEMPERATURE}) END AS size FROM w0),
w2 AS (SELECT s, bytes, coalesce(named, {REST}::DOUBLE * size / sum(size) OVER ()) AS raw FROM w1),
w AS (SELECT s, bytes, raw / sum(raw) OVER () AS weight FROM w2),
a AS (SELECT *, bytes * {MAX_EPOCHS} AS cap, max(bytes / weight) OVER () AS fill FROM w),
b AS (SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
  sum(weight) OVER (ORDER BY cap / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM a),
c AS (SELECT *, (fill - caps) / rest AS level FROM b),
l AS (SELECT arg_min(level, ratio) AS level FROM c WHERE level * weight <= cap),
e AS (SELECT s, least({MAX_EPOCHS}, coalesce(l.level * weight / bytes, {MAX_EPOCHS})) AS epochs FROM c, l),
n AS (SELECT documents.*, (floor(epochs) + CASE WHEN {draw_sql("doc_id", seed)} < epochs - floor(epochs) THEN 1 ELSE 0 END)::BIGINT AS n
  FROM documents JOIN e ON coalesce(source, '') = s)
SELECT {columns}, unnest(range(1, n + 1))::INTEGER AS repetition FROM n"""
