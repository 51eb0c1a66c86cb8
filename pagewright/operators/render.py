"""Documents from pages: Markdown, plain text, JSON reports, manifests, frame documents.

Pages of a document are collected in order of an ordinal, never as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import Str, _c, strip


def ordered(order: Str, *fields: Column) -> Column:
    """An aggregate: structs of the fields, in order."""
    return F.array_sort(F.collect_list(F.struct(_c(order).alias("_o"), *fields)))


def markdown_page(n: Column, text: Column, markdown: Column) -> Column:
    body = strip(F.coalesce(F.when(markdown != "", markdown), text, F.lit("")))
    return F.when(n == 0, F.concat(body, F.lit("\n"))).otherwise(F.concat(F.lit("## Page "), n, F.lit("\n\n"), body, F.lit("\n")))


def text_page(n: Column, text: Column) -> Column:
    return F.concat(F.lit("----- Page "), n, F.lit(" -----\n"), strip(F.coalesce(text, F.lit(""))), F.lit("\n"))


def to_markdown(pages: DataFrame, path: str = "path", order: str = "n", n: str = "n", text: str = "text", markdown: str | None = None, name: Str | None = None) -> DataFrame:
    """path, markdown: the file's name as a title, a heading a page (none for page 0, the whole document)."""
    native = F.col(markdown) if markdown else F.lit(None).cast("string")
    body = F.transform(ordered(order, markdown_page(F.col(n), F.col(text), native).alias("t")), lambda p: p["t"])
    title = F.concat(F.lit("# "), F.regexp_extract(F.col(path).cast("string"), r"[^/]*$", 0) if name is None else F.first(_c(name)), F.lit("\n\n"))
    return pages.groupBy(path).agg(F.array_join(body, "\n").alias("_b")).select(path, F.concat(title, F.col("_b")).alias("markdown"))


def to_text(pages: DataFrame, path: str = "path", order: str = "n", n: str = "n", text: str = "text") -> DataFrame:
    """path, text: a rule with the number before each page, page 0 too."""
    body = F.transform(ordered(order, text_page(F.col(n), F.col(text)).alias("t")), lambda p: p["t"])
    return pages.groupBy(path).agg(F.array_join(body, "\n").alias("text"))


def report(pages: DataFrame, path: str = "path", order: str = "n", n: str = "n", least: float = 60.0) -> DataFrame:
    """path, total_pages, low_conf_pages (rounded confidence below the least), recommend_vision (flagged), in page order."""
    row = ordered(order, F.col(n).alias("n"), (F.coalesce(F.col("mean_conf") < least, F.lit(False))).alias("low"), (F.coalesce(F.col("flag") == "review-vision", F.lit(False))).alias("vision"))
    return pages.groupBy(path).agg(row.alias("_p")).select(
        path, F.size("_p").alias("total_pages"),
        F.transform(F.filter("_p", lambda p: p["low"]), lambda p: p["n"]).alias("low_conf_pages"),
        F.transform(F.filter("_p", lambda p: p["vision"]), lambda p: p["n"]).alias("recommend_vision"),
    )


def to_json(pages: DataFrame, meta: dict, path: str = "path", order: str = "n", least: float = 60.0) -> DataFrame:
    """path, json: file, settings, pages and report. Null fields of a page are left out, but not its confidence and flag."""
    fields = [c for c in pages.columns if c not in (path, order) or c == "n"]
    body = F.transform(ordered(order, F.struct(*fields).alias("p")), lambda p: p["p"])
    rows = pages.groupBy(path).agg(body.alias("pages")).join(report(pages, path, order, "n", least), path)
    settings = [F.lit(meta.get(k, v)).alias(k) for k, v in (("engine", "auto"), ("lang", ""), ("dpi", 0), ("preprocess", "auto"))]
    return rows.select(path, F.to_json(F.struct(F.col(path).alias("file"), *settings, "pages", F.struct("total_pages", "low_conf_pages", "recommend_vision").alias("report"))).alias("json"))


def manifest(pages: DataFrame, prompt: Str, path: str = "path", n: str = "n", image: str = "image") -> DataFrame:
    """path, manifest: the prompt and the image files of the pages, for someone to read them."""
    head = F.concat(F.lit("Pages to be read by eye\n\nPrompt:\n"), F.first(_c(prompt)), F.lit("\n\nPages:\n"))
    rows = F.transform(ordered(n, F.concat(F.lit("  Page "), F.col(n), F.lit(": "), F.col(image)).alias("t")), lambda p: p["t"])
    return pages.groupBy(path).agg(F.concat(head, F.array_join(rows, "\n")).alias("manifest"))


def frames_document(frames: DataFrame, key: list[str], index: str = "index", text: str = "text", markdown: str = "markdown") -> DataFrame:
    """key, frames, text, markdown: the frames' texts parted by blank lines, Markdown under a heading a frame."""
    got = frames.groupBy(*key).agg(ordered(index, F.col(text).alias("t"), F.col(markdown).alias("m")).alias("_f"))
    return got.select(
        *key, F.size("_f").alias("frames"), F.array_join(F.transform("_f", lambda f: f["t"]), "\n\n").alias("text"),
        F.array_join(F.transform("_f", lambda f: F.concat(F.lit("## Frame "), (f["_o"] + 1).cast("string"), F.lit("\n\n"), f["m"])), "\n\n").alias("markdown"),
    )


def totals(pages: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    return pages.groupBy(path).agg(F.count("*").alias("pages"), F.sum(F.char_length(text)).alias("chars"))
