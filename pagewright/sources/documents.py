"""Files as rows: bytes, text-layer pages, triage signals, rendered pages.

Programs that read PDFs run on executors, a file at a time, in ``mapInPandas``; what they print is parsed by built-in
expressions. A failure is a row with an error. Only the columns asked for and the files that pass earlier filters are
read: apply filters on ``path`` before these.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.codes import classify
from pagewright.functions.text import Str, _c
from pagewright.operators.probe import document_info, font_signals, mask_signals, page_width


def files(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """path, input_type, modified, length, content of files in folders or by name."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(list(paths)).select("path", classify("path").alias("input_type"), F.col("modificationTime").alias("modified"), "length", "content")


def split_pages(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, n, text: a page a form feed, numbered as they lie in the file; blank pages keep their numbers.

    A last form feed ends the last page rather than beginning another.
    """
    parts = F.split(F.regexp_replace(text, "\\f\\z", ""), "\\f", -1)
    return texts.select(path, F.posexplode(parts).alias("_p", "text")).select(path, (F.col("_p") + 1).alias("n"), "text")


def _run(call: list[str]) -> tuple[str | None, str | None]:
    """(output, error) of a program."""
    if shutil.which(call[0]) is None:
        return None, f"{call[0]} is not installed"
    done = subprocess.run(call, capture_output=True, text=True, errors="replace")
    return (done.stdout, None) if not done.returncode else (None, f"{call[0]} failed with {done.returncode}")


def _each(call):
    """Runs ``call(file name)``, which gives a dict, for the content of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                with tempfile.TemporaryDirectory() as d:
                    name = os.path.join(d, "input" + (os.path.splitext(path)[1].lower() or ".pdf"))
                    Path(name).write_bytes(content)
                    got = call(name, d)
                rows += [{"path": path} | r for r in (got if isinstance(got, list) else [got])]
            yield pd.DataFrame(rows)

    return run


def _package():
    """The PDF package, or None where it is missing or broken: then the programs are asked."""
    try:
        import fitz

        return fitz if hasattr(fitz, "open") else None
    except (ImportError, OSError):
        return None


def read_text(name: str) -> dict:
    """text (a form feed after each page) and error of a PDF."""
    if package := _package():
        with package.open(name) as pdf:
            return {"text": "".join(page.get_text("text") + "\f" for page in pdf), "error": None}
    text, error = _run(["pdftotext", "-layout", name, "-"])
    return {"text": text, "error": error}


def read_info(name: str) -> str | None:
    """A report of ``Key: value`` lines on a PDF: pages, whether encrypted, size of the first page."""
    package = _package()
    if package is None:
        return _run(["pdfinfo", name])[0]
    with package.open(name) as pdf:
        size = None if pdf.needs_pass or not pdf.page_count else pdf[0].rect
        lines = [f"Pages: {pdf.page_count}", f"Encrypted: {'yes' if pdf.needs_pass else 'no'}"]
        return "\n".join([*lines, f"Page size: {size.width} x {size.height} pts"] if size else lines)


def read_images(name: str, folder: str, dpi: int, wanted: list[int] | None) -> list[dict]:
    """n, content (PNG) and error of a PDF's pages, those wanted or all."""
    if package := _package():
        with package.open(name) as pdf:
            scale = package.Matrix(dpi / 72, dpi / 72)
            found = {i: page.get_pixmap(matrix=scale).tobytes("png") for i, page in enumerate(pdf, 1) if not wanted or i in wanted}
    else:
        span = ["-f", str(min(wanted)), "-l", str(max(wanted))] if wanted else []
        _, error = _run(["pdftoppm", "-png", "-r", str(dpi), *span, name, os.path.join(folder, "page")])
        if error:
            return [{"n": None, "content": None, "error": error}]
        found = {int(f.stem.rpartition("-")[2]): f.read_bytes() for f in Path(folder).glob("page-*.png")}
    return [{"n": n, "content": found.get(n), "error": None if n in found else "no such page"} for n in (wanted or sorted(found))]


def text_layer(pdfs: DataFrame) -> DataFrame:
    """path, text (pages parted by form feeds), error, of PDFs (path, content), as a text extractor gives them."""
    return pdfs.select("path", "content").mapInPandas(_each(lambda name, _: read_text(name)), "path string, text string, error string")


def signals(pdfs: DataFrame) -> DataFrame:
    """path, pages, encrypted, width (points), total_fonts, non_unicode_fonts, image_count, smask_count of PDFs
    (path, content).

    What a program does not tell, or a missing one, is null.
    """

    def call(name: str, _: str) -> dict:
        return {"info": read_info(name)} | {k: _run(c)[0] for k, c in (("fonts", ["pdffonts", name]), ("images", ["pdfimages", "-list", name]))}

    raw = pdfs.select("path", "content").mapInPandas(_each(call), "path string, info string, fonts string, images string")
    known = lambda c, parsed: F.when(F.col(c).isNotNull(), parsed)
    got = raw.select("path", page_width("info").alias("width"), known("info", document_info("info")).alias("i"), known("fonts", font_signals("fonts")).alias("f"), known("images", mask_signals("images")).alias("m"))
    return got.select("path", "i.*", "width", "f.*", "m.*")


def rendered(pdfs: DataFrame, dpi: Str = "dpi", pages: Str = "pages") -> DataFrame:
    """path, n, content (PNG), error: the asked-for pages (array; null: all) of PDFs (path, content) at a resolution."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content, at, want in zip(b["path"], b["content"], b["dpi"], b["pages"]):
                want = None if want is None else [int(n) for n in want]

                def call(name: str, d: str, at=at, want=want) -> list[dict]:
                    return read_images(name, d, int(at), want)

                yield from _each(call)(iter([pd.DataFrame({"path": [path], "content": [content]})]))

    return pdfs.select("path", "content", _c(dpi).alias("dpi"), _c(pages).cast("array<int>").alias("pages")).mapInPandas(run, "path string, n int, content binary, error string")


def rendered_images(images: DataFrame) -> DataFrame:
    """Image files (path, content) as the one page that each is."""
    return images.select("path", F.lit(1).alias("n"), "content", F.lit(None).cast("string").alias("error"))
