"""Page selections: ranges, caps, rows for pages that are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import Str, _c, strip


def parse_range(spec: Str, total: Str) -> Column:
    """Pages of a spec such as 1-3,5: order and repeats kept, those outside 1..total dropped.

    A range that runs backwards is empty. A part that is no number gives null for the whole.
    """

    def pages(part: Column) -> Column:
        ends = F.split(part, "-", 2)
        first, last = strip(ends[0]).try_cast("int"), strip(F.try_element_at(ends, F.lit(2))).try_cast("int")
        many = F.when(first > last, F.array().cast("array<int>")).otherwise(F.sequence(F.least(first, last), last))
        return F.when(F.contains(part, F.lit("-")), many).when(first.isNotNull(), F.array(first))

    parts = F.transform(F.split(_c(spec), ","), lambda p: pages(strip(p)))
    return F.filter(F.flatten(parts), lambda n: n.between(1, _c(total)))


def resolve_range(spec: Str, total: Str, most: Str) -> Column:
    """The selected pages, at most ``most`` of them (0: no cap); null where all are selected.

    A negative cap and a selection of no page raise an error.
    """
    asked = F.coalesce(strip(spec), F.lit("")) != ""
    chosen = F.when(asked, parse_range(spec, total))
    cap = _c(most)
    capped = F.when(cap <= 0, chosen).otherwise(F.when(asked, F.slice(chosen, 1, F.greatest(cap, F.lit(1)))).when(_c(total) > 0, F.sequence(F.lit(1), F.greatest(F.least(_c(total), cap), F.lit(1)))))
    return (
        F.when(cap < 0, F.raise_error(F.lit("max_pages is negative")).cast("array<int>"))
        .when(asked & (F.coalesce(F.size(capped), F.lit(0)) <= 0), F.raise_error(F.concat(F.lit("no such pages: "), _c(spec))).cast("array<int>"))
        .otherwise(capped)
    )


def selected(range_: Str, total: Str) -> Column:
    """A resolved range with null spelt out as all pages."""
    return F.coalesce(_c(range_), F.when(_c(total) > 0, F.sequence(F.lit(1), _c(total))).otherwise(F.array().cast("array<int>")))


def skipped_rows(probe: DataFrame, range_: Str | None = None) -> DataFrame:
    """Placeholder pages of the inputs that would need OCR."""
    pages = selected(F.lit(None).cast("array<int>") if range_ is None else range_, "pages")
    return probe.where(F.col("needs_ocr")).select(
        "path", F.explode(pages).alias("n"), F.lit("skipped").alias("source"), F.lit(None).cast("double").alias("mean_conf"), F.lit(None).cast("string").alias("flag"),
        F.lit("").alias("text"), F.array().cast("array<string>").alias("issues"), F.lit(True).alias("skipped"), F.lit("needs OCR, which is switched off").alias("skip_reason"),
    )
