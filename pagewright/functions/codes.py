"""Codes: languages of scripts and engines, media types, rendering resolution, preprocessing, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Str, _c, mapped, strip

SCHEMA_VERSION = 3
IMAGE_SUFFIXES = tuple("." + s for s in "bmp gif heic jpeg jpg png tif tiff webp".split())
SCRIPT_LANG = dict(p.split("=") for p in "arabic=ara armenian=hye bengali=ben cyrillic=rus devanagari=hin georgian=kat greek=ell han=chi_sim hebrew=heb japanese=jpn korean=kor latin=eng thai=tha".split())
PADDLE_LANG = dict(p.split("=") for p in "ara=arabic ben=bn chi_sim=ch chi_tra=chinese_cht deu=german ell=el eng=en fra=fr heb=he hin=hi ita=it jpn=japan kor=korean por=pt rus=ru spa=es tha=th vie=vi".split())


def suffix(path: Str) -> Column:
    """The last suffix of a path's name, lower-cased; none for a name that begins with its only dot."""
    return F.lower(F.regexp_extract(_c(path), r"[^/](\.[^./]+)$", 1))


def classify(path: Str) -> Column:
    """pdf, image or unsupported, by suffix alone."""
    s = suffix(path)
    return F.when(s == ".pdf", "pdf").when(s.isin(*IMAGE_SUFFIXES), "image").otherwise("unsupported")


def script_lang(script: Str, confidence: Str) -> Column:
    """The recogniser's language for a detected script, with English; English alone if unsure or unknown."""
    found = mapped(F.lower(strip(script)), SCRIPT_LANG, F.lit("eng"))
    sure = F.coalesce(_c(confidence).cast("double"), F.lit(0.0)) >= 1.0
    return F.when(sure & (found != "eng"), F.concat(found, F.lit("+eng"))).otherwise("eng")


def detected_lang(report: Str) -> Column:
    """script_lang of the text that orientation and script detection prints: the last of each of its lines."""
    script = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(_c(report), F.lit(r"(?im)^(?![^\n]*confidence)[^\n]*?script:([^\n]*)$"), 1)), -1)
    confidence = F.element_at(F.concat(F.array(F.lit("0")), F.regexp_extract_all(_c(report), F.lit(r"(?im)^[^\n]*?script confidence:\s*([0-9.]+)\s*$"), 1)), -1)
    return script_lang(script, confidence.try_cast("double"))


def paddle_lang(lang: Str) -> Column:
    """The line recogniser's code for the first language of a spec such as rus+eng; en for none, auto or unknown."""
    first = F.lower(strip(F.split(F.coalesce(_c(lang), F.lit("")), r"\+")[0]))
    return mapped(first, PADDLE_LANG, F.lit("en"))


def auto_dpi(width: Str, input_type: Str) -> Column:
    """Rendering resolution by page width in points (595 if unknown); images count as 150."""
    w = F.coalesce(_c(width).cast("double"), F.lit(595.0))
    return F.when(_c(input_type) == "image", 150).when(w > 1000, 150).when(w > 700, 200).otherwise(300)


def preprocess_level(level: Str, input_type: Str, needs_ocr: Str, enhanced: Str) -> Column:
    """auto resolved: none for images; enhanced, where it can be had, for PDFs that need OCR; else basic."""
    best = F.when(F.coalesce(_c(enhanced), F.lit(False)), "enhanced").otherwise("basic")
    auto = F.when(_c(input_type) == "image", "none").when(F.coalesce(_c(needs_ocr), F.lit(False)), best).otherwise("basic")
    return F.when(_c(level) != "auto", _c(level)).otherwise(auto)


def media_type(content: Str) -> Column:
    """By magic bytes: JPEG, PNG, WebP; PNG for anything else."""
    head = F.hex(F.substring(_c(content), 1, 12))
    webp = F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250")
    return F.when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg").when(webp, "image/webp").otherwise("image/png")


IMAGE_BYTES = 7_500_000


def page_base64(content: Str) -> Column:
    """Base64 without line breaks of an image within IMAGE_BYTES; null beyond, which must first be reduced."""
    return F.when(F.octet_length(_c(content)) <= IMAGE_BYTES, F.regexp_replace(F.base64(_c(content)), r"[\r\n]", ""))


def cache_key(path: Str, mtime: Str, size: Str, engine: Str, dpi: Str, preprocess: Str, lang: Str, pages: Str, context: Str | None = None) -> Column:
    """SHA-1 of all that a page result depends on, the schema version too; the engine's context only if there is one."""
    parts = [_c(path), _c(mtime).cast("string"), _c(size).cast("string"), _c(engine), _c(dpi).cast("string"), _c(preprocess), _c(lang), F.concat(F.lit("pages="), _c(pages)), F.lit(f"schema={SCHEMA_VERSION}")]
    raw = F.concat_ws("|", *parts)
    if context is not None:
        raw = F.concat(raw, F.when(F.coalesce(_c(context), F.lit("")) != "", F.concat(F.lit("|engine_context="), _c(context))).otherwise(""))
    return F.sha1(raw)


def workflow_key(*fields: str) -> Column:
    """SHA-1 of the JSON of the named columns in order of name."""
    return F.sha1(F.to_json(F.struct(*(F.col(f) for f in sorted(fields)))))


def poly_bbox(poly: Str) -> Column:
    """[left, top, width, height] of a polygon of (x, y) points, each truncated to whole numbers."""
    xs, ys = F.transform(_c(poly), lambda p: p[0].cast("int")), F.transform(_c(poly), lambda p: p[1].cast("int"))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
