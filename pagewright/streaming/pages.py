"""Pages as they arrive: triage of each arriving file, and windowed measures of page quality. An addition of this
library: batch results and stream results come from the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.functions.text import readability
from pagewright.operators import probe


def page_signals(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages with density and readability and whether each page by itself is dense and readable: stateless, one pass."""
    r = F.col("readability")
    good = (r["letter_digit_ratio"] >= probe.MIN_ALNUM) & (r["word_score"] >= probe.MIN_WORDS) & (r["replacement_ratio"] <= probe.MAX_BAD)
    got = probe.page_density(pages, text).withColumn("readability", readability(text))
    return got.withColumn("usable", (F.col("chars") >= probe.MIN_CHARS) & good)


def quality_windows(pages: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "30 minutes", text: str = "text") -> DataFrame:
    """start, pages, usable, chars by window of event time; a page later than ``late`` is not counted."""
    got = page_signals(pages.withWatermark(time, late), text)
    got = got.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("pages"), F.count_if("usable").alias("usable"), F.sum("chars").alias("chars"))
    return got.select(F.col("w.start").alias("start"), "pages", "usable", "chars")


def triage_stream(pages: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Triage rows of the files of each micro-batch, in ``out/batch=N``; a batch that is run again is replaced.

    The pages of a file must arrive together, as those of a source with a row a page of a finished file do.
    """

    def each(batch: DataFrame, n: int) -> None:
        probe.probe_pdfs(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
