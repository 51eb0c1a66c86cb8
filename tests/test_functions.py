"""Boundary cases of the page functions, each against its stated value."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pagewright.functions import codes as C
from pagewright.functions import text as T
from pagewright.operators import geometry, pagesets, probe, quality


def value(spark, column, **row):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in row.items())).select(column.alias("v")).first().v if row else spark.range(1).select(column.alias("v")).first().v


READABLE = {"letter_digit_ratio": 0.9, "word_score": 0.9, "replacement_ratio": 0.0}


@pytest.mark.parametrize(
    "encrypted, median, fonts, bare, masks, readable, want",
    [
        (False, 29, 0, 0, 0, True, ("ready", False, True)),
        (False, 30, 1, 0, 0, True, ("ready", True, False)),
        (False, 30, 1, 1, 3, True, ("ready", False, True)),
        (False, 30, 1, 1, 2, True, ("ready", True, False)),
        (True, 500, 1, 0, 0, True, ("blocked", False, False)),
        (False, 500, None, None, None, True, ("ready", True, False)),
        (False, 500, 1, 0, 0, False, ("ready", False, True)),
        (False, 500, 1, 0, 0, None, ("ready", True, False)),
    ],
)
def test_triage_boundaries(spark, encrypted, median, fonts, bare, masks, readable, want):
    ratios = None if readable is None else (0.9, 0.9, 0.0) if readable else (0.9, 0.4, 0.0)
    df = spark.createDataFrame([(encrypted, median, fonts, bare, masks, ratios)], "e boolean, m bigint, f int, b int, s int, r struct<letter_digit_ratio:double,word_score:double,replacement_ratio:double>")
    d = df.select(probe.decide("e", "m", "f", "b", "s", "r").alias("d")).first().d
    assert (d.status, d.has_text_layer, d.needs_ocr) == want
    assert d.text_layer_rejected == (readable is False)


def test_density_counts_bytes(spark):
    assert value(spark, T.nonspace_bytes(F.lit("привет мир кириллица ещ"))) == 40
    assert value(spark, T.nonspace_bytes(F.lit(" \t\n  "))) == 0


@pytest.mark.parametrize("text, good", [("#$%^ &*() @!~ {}[] <>|", False), ("Общий анализ крови: гемоглобин 140 г/л", True), ("12,5 13.7 2024-01-02 99% 1/2 +3", True), ("a b c d e f g h", False), ("", False)])
def test_readability(spark, text, good):
    r = value(spark, T.readability(F.lit(text)))
    assert (r.letter_digit_ratio >= 0.55 and r.word_score >= 0.5 and r.replacement_ratio <= 0.05) == good


def test_cleanup_order(spark):
    dirty = "ﬁrst\x07  line\t\tend\nhyphen-\n  ated\n\n\n\nlast  "
    assert value(spark, T.cleanup(F.lit(dirty))) == "first line end\nhyphenated\n\nlast"


def test_markdown_flattened(spark):
    text = "# Head\n\n| a | b |\n|---|---|\n| 1 | [x](http://y) |\n|| 2 |\n**bold** `code`\n"
    assert value(spark, T.markdown_to_text(F.lit(text))) == "Head\n\na\tb\n1\tx\n2\nbold code"


@pytest.mark.parametrize(
    "spec, total, most, want",
    [("1-3,5", 10, 0, [1, 2, 3, 5]), ("1-3,5", 4, 0, [1, 2, 3]), ("2-5", 10, 2, [2, 3]), ("", 10, 2, [1, 2]), ("", 10, 0, None), ("3-1,2", 5, 0, [2]), ("2,2", 5, 0, [2, 2])],
)
def test_page_ranges(spark, spec, total, most, want):
    assert value(spark, pagesets.resolve_range(F.col("s"), F.col("t"), F.col("m")), s=spec, t=total, m=most) == want


@pytest.mark.parametrize("spec, most", [("999", 0), ("", -1), ("x", 0)])
def test_bad_page_ranges(spark, spec, most):
    with pytest.raises(PySparkException):
        value(spark, pagesets.resolve_range(F.col("s"), F.col("t"), F.col("m")), s=spec, t=10, m=most)


def test_codes(spark):
    assert [value(spark, C.paddle_lang(F.lit(x))) for x in ("rus+eng", "chi_sim", "auto", "xyz", "")] == ["ru", "ch", "en", "en", "en"]
    assert [value(spark, C.classify(F.lit(x))) for x in ("/a/B.PDF", "/a/x.jpeg", "/a/.pdf", "/a/x.tar.gz", "x")] == ["pdf", "image", "unsupported", "unsupported", "unsupported"]
    assert [value(spark, C.auto_dpi(F.lit(w), F.lit("pdf"))) for w in (1001, 1000, 701, 700, None)] == [150, 200, 200, 300, 300]
    assert value(spark, C.detected_lang(F.lit("Orientation: 0\nScript: Cyrillic\nScript confidence: 3.2\n"))) == "rus+eng"
    assert value(spark, C.detected_lang(F.lit("Script: Cyrillic\nScript confidence: 0.9\n"))) == "eng"
    assert value(spark, C.detected_lang(F.lit("no report"))) == "eng"
    body = b"\x89PNG\r\n\x1a\n" + bytes(300)
    import base64

    assert value(spark, C.page_base64(F.lit(bytearray(body)))) == base64.b64encode(body).decode()


def test_line_recogniser_order_and_boxes(spark):
    df = spark.createDataFrame([(["second", "first", " "], [0.8, 0.9, 0.1], [[[10, 50], [110, 50], [110, 70], [10, 70]], [[10, 5], [110, 5], [110, 25], [10, 25]]])], "t array<string>, s array<double>, p array<array<array<int>>>")
    r = df.select(geometry.line_words("t", "s", "p").alias("w"), geometry.line_mean("t", "s").alias("m")).first()
    assert [(w.text, w.conf, w.bbox) for w in r.w] == [("first", 90, [10, 5, 100, 20]), ("second", 80, [10, 50, 100, 20])]
    assert r.m == pytest.approx(85.0)


def test_engine_results_agree_with_expressions():
    from pagewright.functions import engines

    got = engines.line_result(["second", "first", " "], [0.8, 0.9, 0.1], [[[10, 50], [110, 70]], [[10, 5], [110, 25]]])
    assert [w["text"] for w in got["words"]] == ["first", "second"] and got["mean_conf"] == pytest.approx(85.0) and got["text"] == "first\nsecond"
    assert engines._markdown_of([{"markdown": {"markdown_texts": ["a", "b"]}}, {"markdown": {"markdown_texts": " "}}, {}]) == "a\nb"
    assert engines.fitted(b"\xff\xd8\xff" + bytes(9)) == (b"\xff\xd8\xff" + bytes(9), "image/jpeg")
    assert engines.fitted(b"RIFF0000WEBP")[1] == "image/webp" and engines.fitted(b"")[1] == "image/png"


def test_flags_use_the_unrounded_confidence(spark):
    df = spark.createDataFrame([(59.96, []), (60.0, []), (None, [])], "c double, w array<struct<text:string,conf:int,bbox:array<int>>>")
    got = [r[0] for r in df.select(quality.flag(quality.issues("c", "w"))).collect()]
    assert got == ["review-vision", None, None]


def test_table_rows_need_words_and_zones(spark):
    grid = lambda rows, columns, pitch: [("w", 90, [c * pitch, 12 * r, 30, 10]) for r in range(rows) for c in range(columns)]
    pages = [grid(3, 4, 100), grid(2, 4, 100), grid(3, 3, 100), grid(4, 4, 5), [("w", 90, [0, 0, 1, 1])] * 8, []]
    df = spark.createDataFrame([(p,) for p in pages], "w array<struct<text:string,conf:int,bbox:array<int>>>")
    assert [r[0] for r in df.select(geometry.looks_tabular("w")).collect()] == [True, False, False, False, False, False]
