"""Triage: is a file's text layer dense and readable enough to be used, or does it need OCR?

One row a page goes in, one a file comes out. Pages are grouped once; the median, the sample and the counts come
from one shuffle by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.codes import classify
from pagewright.functions.text import Str, _c, four_places, nonspace_bytes, ratios, readability_counts, strip

MIN_CHARS, MIN_ALNUM, MIN_WORDS, MAX_BAD, MASKS, SAMPLE_PAGES = 30, 0.55, 0.5, 0.05, 3, 3


def page_density(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.withColumn("chars", nonspace_bytes(text))


def upper_median(values: Column) -> Column:
    """Of an array: the element in the middle, the upper of two; 0 for none."""
    return F.coalesce(F.try_element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1), F.lit(0))


def files(pages: DataFrame, path: str = "path", n: str = "n", text: str = "text") -> DataFrame:
    """path, pages, per_page_chars (in page order), median_chars, sample: the three densest pages' text.

    Only those three texts are kept while grouping: the page texts are ranked first, by a window over the same
    partitioning, so a long file's text is not collected.
    """
    from pyspark.sql.window import Window

    dense = page_density(pages, text)
    rank = F.row_number().over(Window.partitionBy(path).orderBy(F.desc("chars"), F.col(n)))
    ranked = dense.withColumn("_rank", rank)
    top = F.when(F.col("_rank") <= SAMPLE_PAGES, F.struct(F.col("_rank"), F.col(text)))
    got = ranked.groupBy(path).agg(
        F.count("*").cast("int").alias("pages"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(n).alias("n"), "chars"))), lambda p: p["chars"]).alias("per_page_chars"),
        F.array_sort(F.collect_list(top)).alias("_top"),
    )
    sample = strip(F.array_join(F.transform("_top", lambda p: p[text]), "\n"))
    return got.select(path, "pages", "per_page_chars", upper_median(F.col("per_page_chars")).alias("median_chars"), sample.alias("sample"))


def plain(x: Column) -> Column:
    """A ratio as text: no exponent, no trailing zeros, one decimal at least."""
    return F.regexp_replace(F.regexp_replace(x.cast("decimal(5,4)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")


def decide(encrypted: Str, median: Str, fonts: Str, bare_fonts: Str, masks: Str, readability: Str) -> Column:
    """Struct of status, has_text_layer, needs_ocr, text_layer_rejected, suspected_rasterized_text,
    high_image_coverage, font_unicode_coverage, reason.

    ``bare_fonts`` are those without a Unicode map. Null fonts, masks or readability mean not known, and count for
    the text layer.
    """
    median, fonts, masks, r = F.coalesce(_c(median), F.lit(0)), _c(fonts), _c(masks), _c(readability)
    bare, locked = F.coalesce(_c(bare_fonts), F.lit(0)), F.coalesce(_c(encrypted), F.lit(False))
    suspected = F.coalesce((fonts == 0) | (bare > 0), F.lit(False)) & fonts.isNotNull()
    covered = F.coalesce(masks >= MASKS, F.lit(False))
    good = r.isNull() | ((r["letter_digit_ratio"] >= MIN_ALNUM) & (r["word_score"] >= MIN_WORDS) & (r["replacement_ratio"] <= MAX_BAD))
    dense = median >= MIN_CHARS
    usable = ~locked & dense & good & ~(suspected & covered)
    rejected = ~locked & dense & ~good
    main = (
        F.when(locked, "PDF is encrypted; decrypt it before processing")
        .when(usable, F.concat(F.lit("median "), median, F.lit(" chars/page; usable text layer")))
        .when(rejected, F.concat(F.lit("unreadable text layer (letters="), plain(r["letter_digit_ratio"]), F.lit(", words="), plain(r["word_score"]), F.lit(", repl="), plain(r["replacement_ratio"]), F.lit(")")))
        .otherwise(F.concat(F.lit("median "), median, F.lit(f" non-space chars/page (threshold: {MIN_CHARS})")))
    )
    fonts_say = F.when(suspected, F.when(fonts == 0, "no fonts found").otherwise(F.concat(bare, F.lit("/"), fonts, F.lit(" fonts non-Unicode"))))
    all_bare = F.when(rejected & (fonts > 0) & (bare == fonts), "all fonts non-Unicode (no ToUnicode map)")
    return F.struct(
        F.when(locked, "blocked").otherwise("ready").alias("status"),
        usable.alias("has_text_layer"),
        (~locked & ~usable).alias("needs_ocr"),
        rejected.alias("text_layer_rejected"),
        suspected.alias("suspected_rasterized_text"),
        covered.alias("high_image_coverage"),
        F.when(fonts > 0, four_places((fonts - bare) / fonts)).alias("font_unicode_coverage"),
        F.concat_ws("; ", main, all_bare, fonts_say, F.when(covered, F.concat(masks, F.lit(" image masks detected")))).alias("reason"),
    )


def probe_pdfs(pages: DataFrame, signals: DataFrame | None = None, path: str = "path", n: str = "n", text: str = "text") -> DataFrame:
    """One row a PDF. ``signals`` may give encrypted, total_fonts, non_unicode_fonts, image_count, smask_count by path."""
    got = files(pages, path, n, text)
    known = {"encrypted": "boolean", "total_fonts": "int", "non_unicode_fonts": "int", "image_count": "int", "smask_count": "int"}
    if signals is not None:
        got = got.join(signals.select(path, *(c for c in known if c in signals.columns)), path, "left")
    for c, kind in known.items():
        if c not in got.columns:
            got = got.withColumn(c, F.lit(None).cast(kind))
    got = got.withColumn("encrypted", F.coalesce("encrypted", F.lit(False)))
    got = got.withColumn("readability", F.when(F.col("sample") != "", ratios(readability_counts("sample")))).drop("sample")
    got = got.withColumn("_d", decide("encrypted", "median_chars", "total_fonts", "non_unicode_fonts", "smask_count", "readability"))
    return got.select(path, F.lit("pdf").alias("input_type"), *(c for c in got.columns if c not in (path, "_d")), "_d.*")


def probe_images(paths: DataFrame, path: str = "path") -> DataFrame:
    """The constant answer for images: they need OCR."""
    none = lambda kind: F.lit(None).cast(kind)
    return paths.select(
        path, F.lit("image").alias("input_type"), F.lit(1).alias("pages"), F.array(F.lit(0)).cast("array<bigint>").alias("per_page_chars"), F.lit(0).cast("bigint").alias("median_chars"),
        F.lit(False).alias("encrypted"), none("int").alias("total_fonts"), none("int").alias("non_unicode_fonts"), none("int").alias("image_count"), none("int").alias("smask_count"),
        none("struct<letter_digit_ratio:double,word_score:double,replacement_ratio:double>").alias("readability"), F.lit("ready").alias("status"), F.lit(False).alias("has_text_layer"),
        F.lit(True).alias("needs_ocr"), F.lit(False).alias("text_layer_rejected"), F.lit(False).alias("suspected_rasterized_text"), F.lit(False).alias("high_image_coverage"),
        none("double").alias("font_unicode_coverage"), F.lit("image input requires OCR").alias("reason"),
    )


def probe_inputs(paths: DataFrame, pages: DataFrame, signals: DataFrame | None = None, path: str = "path") -> DataFrame:
    """One row an input, PDFs by their pages and images alike; an unsupported file raises an error."""
    kind = classify(path)
    known = paths.select(path).withColumn("_kind", F.when(kind == "unsupported", F.raise_error(F.concat(F.lit("unsupported file type: "), F.col(path)))).otherwise(kind))
    pdfs = probe_pdfs(pages.join(known.where("_kind = 'pdf'").select(path), path, "left_semi"), signals, path)
    return pdfs.unionByName(probe_images(known.where("_kind = 'image'"), path))


def font_signals(listing: Str) -> Column:
    """Struct of total_fonts, non_unicode_fonts from a font listing: two header lines, the sixth column says whether mapped."""
    rows = _rows(listing)
    return F.struct(F.size(rows).alias("total_fonts"), F.size(F.filter(rows, lambda r: F.lower(F.coalesce(F.try_element_at(r, F.lit(6)), F.lit(""))) == "no")).alias("non_unicode_fonts"))


def mask_signals(listing: Str) -> Column:
    """Struct of image_count, smask_count from an image listing: two header lines, the third column is the kind."""
    rows = _rows(listing)
    return F.struct(F.size(rows).alias("image_count"), F.size(F.filter(rows, lambda r: F.lower(F.coalesce(F.try_element_at(r, F.lit(3)), F.lit(""))) == "smask")).alias("smask_count"))


def _rows(listing: Str) -> Column:
    from pagewright.functions.text import lines

    body = F.filter(F.transform(lines(listing), strip), lambda v: F.lit(True))
    body = F.slice(body, 3, F.greatest(F.size(body) - 2, F.lit(0)))
    return F.transform(F.filter(body, lambda v: v != ""), lambda v: F.split(v, r"\s+"))


def document_info(report: Str) -> Column:
    """Struct of pages, encrypted from a document report of ``Key: value`` lines."""
    pages = F.regexp_extract(_c(report), r"(?im)^pages:\s*(\d+)", 1).try_cast("int")
    return F.struct(pages.alias("pages"), _c(report).rlike(r"(?im)^encrypted:\s*yes").alias("encrypted"))


def page_width(report: Str) -> Column:
    """Width in points of the first page, from a document report; null if it doesn't say."""
    return F.regexp_extract(_c(report), r"(?im)^[^\n]*page size[^\n\d]*([\d.]+)", 1).try_cast("double")
