"""Choice among a flagged page's attempts, as an ordered fold.

The first attempt is the baseline. A structured engine is selected whenever it comes; another one if its score,
(not flagged, confidence, words), is above the best of the local engines so far. A structured engine's result thus
stands unless a later local engine sets a record. As rows: an attempt is *eligible* by the running maximum before
it, and the last eligible one is selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRUCTURED = ("vision", "paddleocr-vl-mlx")


def score(flag: str = "flag", conf: str = "mean_conf", words: str = "n_words") -> Column:
    return F.struct(F.col(flag).isNull().alias("ok"), F.coalesce(F.col(conf), F.lit(0.0)).alias("c"), F.col(words).cast("int").alias("w"))


def eligible(attempts: DataFrame, page: list[str], order: str = "i", engine: str = "engine") -> DataFrame:
    """attempts with ``eligible``."""
    structured = F.col(engine).isin(*STRUCTURED)
    before = Window.partitionBy(*page).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    got = attempts.withColumns({"_score": score(), "_local": (F.col(order) == 0) | ~structured})
    got = got.withColumn("_best", F.max(F.when(F.col("_local"), F.col("_score"))).over(before))
    return got.withColumn("eligible", (F.col(order) == 0) | structured | (F.col("_score") > F.col("_best"))).drop("_score", "_local", "_best")


def select(attempts: DataFrame, page: list[str], order: str = "i", engine: str = "engine") -> DataFrame:
    """A row a page: baseline, selected engine and its place, all attempts in order. One shuffle, by page."""
    got = eligible(attempts, page, order, engine)
    pick = F.when(F.col("eligible"), F.col(order))
    return got.groupBy(*page).agg(
        F.min_by(engine, order).alias("baseline"),
        F.max_by(engine, pick).alias("selected"),
        F.max(pick).alias("selected_i"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(engine).alias("engine"), F.col("mean_conf")))), lambda a: F.struct(a["engine"].alias("engine"), F.lit("completed").alias("status"), a["mean_conf"].alias("mean_conf"))).alias("attempts"),
    )


def merge_selected(pages: DataFrame, chosen: DataFrame, page: list[str], columns: list[str]) -> DataFrame:
    """pages with the columns of the chosen attempt where there is one; number and order stay the page's own."""
    new = chosen.select(*page, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_chosen"))
    got = pages.join(new, page, "left")
    return got.withColumns({c: F.when(F.col("_chosen"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).drop("_chosen", *(f"_new_{c}" for c in columns))
