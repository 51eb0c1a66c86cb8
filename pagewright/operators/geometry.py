"""Word boxes: reading order, table detection, parsing of recognisers' output.

Words are an array of (text, conf, bbox) with bbox [left, top, width, height]; all functions are expressions on
that array, so a page's words need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.codes import poly_bbox
from pagewright.functions.text import Str, _c, lines, once, strip

WORDS = "array<struct<text:string,conf:int,bbox:array<int>>>"
FEWEST_WORDS, ROW_PX, ZONES, LEAST_ZONE, ROW_WORDS, ROW_ZONES, TABLE_ROWS = 9, 10, 6, 50, 4, 3, 3


def looks_tabular(words: Str) -> Column:
    """Whether three rows of ten pixels each have four words or more in three zones or more of the page's width."""
    # sorted cells in one pass: a row is counted at the cell where it first has enough of both
    none = F.lit(None).cast("bigint")
    start = F.struct(none.alias("y"), none.alias("c"), F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(0).alias("rows"))

    def step(s: Column, x: Column) -> Column:
        same = F.coalesce(s["y"] == x["y"], F.lit(False))
        n = F.when(same, s["n"] + 1).otherwise(1)
        k = F.when(~same, 1).when(s["c"] == x["c"], s["k"]).otherwise(s["k"] + 1)
        was = same & (s["n"] >= ROW_WORDS) & (s["k"] >= ROW_ZONES)
        now = (n >= ROW_WORDS) & (k >= ROW_ZONES)
        return F.struct(x["y"].alias("y"), x["c"].alias("c"), n.alias("n"), k.alias("k"), (s["rows"] + F.when(now & ~was, 1).otherwise(0)).alias("rows"))

    def rows(s: Column) -> Column:
        cells = F.array_sort(F.transform(s["w"], lambda x: F.struct(F.floor(x["bbox"][1] / ROW_PX).alias("y"), F.floor(x["bbox"][0] / s["zone"]).alias("c"))))
        return F.aggregate(cells, start, step, lambda s: s["rows"] >= TABLE_ROWS)

    def zoned(w: Column) -> Column:
        lefts = F.transform(w, lambda x: x["bbox"][0])
        width = once(lefts, lambda x: F.array_max(x) - F.array_min(x) + 1)
        return F.struct(w.alias("w"), F.greatest(F.floor(width / ZONES), F.lit(LEAST_ZONE)).alias("zone"))

    # the words and the zone are evaluated once, not once a word
    found = lambda w: F.coalesce(once(zoned(w), rows), F.lit(False))
    return once(_c(words), lambda w: F.when(F.size(w) < FEWEST_WORDS, False).otherwise(found(w)))


def reading_order(words: Str) -> Column:
    """Words from top to bottom, then left to right; ties as they came."""
    keyed = F.transform(_c(words), lambda x, i: F.struct(x["bbox"][1].alias("t"), x["bbox"][0].alias("l"), i.alias("i"), x.alias("w")))
    return F.transform(F.array_sort(keyed), lambda k: k["w"])


def line_words(texts: Str, scores: Str, polys: Str) -> Column:
    """Words of a line recogniser's parallel arrays: blanks dropped, reading order. A missing score is 0, a missing polygon empty."""
    blank = F.array(*[F.array(F.lit(0), F.lit(0)) for _ in range(4)])
    conf = lambda s, i: (F.coalesce(F.try_element_at(s["scores"], i + 1), F.lit(0.0)) * 100).cast("int")
    bbox = lambda s, i: poly_bbox(F.coalesce(F.try_element_at(s["polys"], i + 1), blank))
    arrays = F.struct(_c(texts).alias("texts"), _c(scores).alias("scores"), _c(polys).alias("polys"))
    made = once(arrays, lambda s: F.transform(s["texts"], lambda t, i: F.struct(t.alias("text"), conf(s, i).alias("conf"), bbox(s, i).alias("bbox"))))
    return reading_order(F.filter(made, lambda w: strip(w["text"]) != ""))


def line_mean(texts: Str, scores: Str) -> Column:
    """Mean confidence in per cent of the lines that are not blank, of the scores before truncation; 0 for none."""
    arrays = F.struct(_c(texts).alias("texts"), _c(scores).alias("scores"))
    told = lambda a: F.transform(a["texts"], lambda t, i: F.when(strip(t) != "", F.coalesce(F.try_element_at(a["scores"], i + 1), F.lit(0.0))))
    kept = F.filter(once(arrays, told), lambda s: s.isNotNull())
    return once(kept, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda a, s: a + s) / F.size(k) * 100).otherwise(0.0))


def _tsv_rows(tsv: Str) -> Column:
    below = once(lines(tsv), lambda v: F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))))
    rows = F.transform(below, lambda v: F.split(v, "\t", -1))
    kept = F.filter(rows, lambda r: F.size(r) >= 12)
    made = F.transform(kept, lambda r: F.struct(strip(r[11]).alias("text"), r[10].try_cast("double").alias("conf"), F.array(*(r[i].try_cast("int") for i in (6, 7, 8, 9))).alias("bbox")))
    return F.filter(made, lambda w: w["conf"].isNotNull() & (w["conf"] != -1) & (w["text"] != ""))


def tsv_words(tsv: Str) -> Column:
    """Words of a recogniser's tab-separated table: confidence in column 11, text in 12, box in 7 to 10.

    Short rows, blank words and rows without a confidence are dropped; an unreadable box is all zeros.
    """
    zero = F.array(*[F.lit(0)] * 4)
    return F.transform(_tsv_rows(tsv), lambda w: F.struct(w["text"].alias("text"), w["conf"].cast("int").alias("conf"), F.when(F.exists(w["bbox"], lambda b: b.isNull()), zero).otherwise(w["bbox"]).alias("bbox")))


def tsv_mean(tsv: Str) -> Column:
    return once(_tsv_rows(tsv), lambda r: F.when(F.size(r) > 0, F.aggregate(r, F.lit(0.0), lambda a, w: a + w["conf"]) / F.size(r)).otherwise(0.0))


def better_retry(mean: Str, words: Str, retry_mean: Str, retry_words: Str) -> Column:
    """Whether a second pass in two languages is taken: more words, or any words at over five points' more confidence."""
    a, b = F.coalesce(F.size(_c(words)), F.lit(0)), F.coalesce(F.size(_c(retry_words)), F.lit(0))
    return (b > a) | ((b > 0) & (_c(retry_mean) > _c(mean) + 5))
