"""The workflow, its cache, commands, sources, outputs and streams."""

import io
import json
import os
from importlib.util import find_spec

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pagewright import api, cli
from pagewright.functions import engines, preprocess
from pagewright.functions import requirements as R
from pagewright.operators import outputs, probe
from pagewright.operators.cache import Cache
from pagewright.plans import frame_sink
from pagewright.plans.recognize import Options, recognize, recognize_images
from pagewright.sources import documents, frames
from pagewright.streaming import pages as streams

GOOD = "These are plain readable words that make a usable layer of text"


def reader(conf, fail=False):
    """An engine that reads the words in a page's bytes or text."""

    def run(batches):
        import pandas as pd

        for b in batches:
            texts = [(c or b"").decode() for c in b["content"]] if "content" in b else list(b["text"])
            words = [[{"text": w, "conf": conf, "bbox": [0, 12 * i, 9, 9]} for i, w in enumerate(t.split())] for t in texts]
            yield pd.DataFrame({"path": b["path"], "n": b["n"], "text": texts, "markdown": None, "mean_conf": float(conf), "words": words, "error": "it broke" if fail else None})

    return run


@pytest.fixture(autouse=True, scope="module")
def test_engines():
    for name, conf in (("low", 40), ("high", 90)):
        engines.register_engine(name, reader(conf))
    engines.register_engine("broken", reader(90, True))
    yield
    for name in ("low", "high", "broken"):
        engines._ENGINES.pop(name)


@pytest.fixture
def pages(spark):
    rows = [("good.pdf", 1, GOOD), ("good.pdf", 2, GOOD), ("bad.pdf", 1, "x"), ("bad.pdf", 2, "few words"), ("odd.pdf", 1, "#$%^ &*() @!~ {}[] <>| #$%^ &*() @!~ {}[] <>|")]
    return spark.createDataFrame(rows, "path string, n int, text string")


def by_page(df):
    return {(r.path, r.n): r for r in df.collect()}


def test_text_layer_skips_the_engine(pages):
    got = by_page(recognize(pages, Options(engine="low")))
    assert {k: r.source for k, r in got.items()} == {("good.pdf", 1): "text_layer", ("good.pdf", 2): "text_layer", ("bad.pdf", 1): "low", ("bad.pdf", 2): "low", ("odd.pdf", 1): "low"}
    assert got["good.pdf", 1].mean_conf == 100.0 and got["good.pdf", 1].flag is None
    assert got["bad.pdf", 1].issues == ["low_confidence"] and got["bad.pdf", 1].flag == "review-vision"
    assert got["odd.pdf", 1].issues == ["low_confidence", "text_layer_rejected"]


def test_escalation_replaces_flagged_pages_and_says_how(pages):
    got = by_page(recognize(pages, Options(engine="low", auto_escalate=("high",))))
    r = got["bad.pdf", 2]
    assert r.source == "high" and r.mean_conf == 90.0 and r.flag is None
    assert (r.decision.baseline, r.decision.selected, r.decision.flag_reason) == ("low", "high", ["low_confidence"])
    assert [(a.engine, a.status, a.mean_conf) for a in r.decision.attempts] == [("low", "completed", 40.0), ("high", "completed", 90.0)]
    assert got["good.pdf", 1].decision is None


def test_options(pages):
    two = pages.where("path <> 'odd.pdf'")
    assert set(by_page(recognize(two, Options(engine="low", pages="2")))) == {("good.pdf", 2), ("bad.pdf", 2)}
    assert {r.source for r in recognize(pages, Options(engine="high", force=True)).collect()} == {"high"}
    got = by_page(recognize(pages, Options(skip_ocr=True)))
    assert got["bad.pdf", 1].skipped and got["bad.pdf", 1].source == "skipped" and not got["good.pdf", 1].skipped


def test_errors_stop_everything(pages, spark, tmp_path):
    kept = Cache(spark, str(tmp_path / "cache"))
    with pytest.raises(PySparkException, match="it broke"):
        recognize(pages, Options(engine="broken"), cached=kept).collect()
    assert kept.count() == 0
    locked = spark.createDataFrame([("good.pdf", True)], "path string, encrypted boolean")
    with pytest.raises(ValueError, match="encrypted"):
        recognize(pages, Options(engine="low"), locked)


def test_cache_hits_need_no_engine(pages, spark, tmp_path):
    kept = Cache(spark, str(tmp_path / "cache"))
    first = recognize(pages, Options(engine="high"), cached=kept).collect()
    assert kept.count() == 3
    engines.register_engine("high", reader(90, True))
    try:
        again = recognize(pages, Options(engine="high"), cached=kept).collect()
    finally:
        engines.register_engine("high", reader(90))
    key = lambda r: (r.path, r.n)
    assert sorted(first, key=key) == sorted(again, key=key)
    (tmp_path / "cache" / "current.json").write_text("no json")
    assert Cache(spark, str(tmp_path / "cache")).count() == 0 and Cache(spark, None).count() == 0


def test_a_cache_grows_by_parts(spark, tmp_path, monkeypatch):
    row = lambda *keys: spark.createDataFrame([(k, v) for k, v in keys], "key string, v int")
    kept = Cache(spark, str(tmp_path / "cache"))
    have = lambda: sorted((r.key, r.v) for r in kept.load("key string, v int").collect())
    assert have() == []
    kept.merge(row(("a", 1)))
    kept.merge(row(("b", 2)))
    assert have() == [("a", 1), ("b", 2)] and len(kept.parts()) == 2
    before = kept.load("key string, v int")
    kept.merge(row(("a", 3), ("c", 4)))
    assert have() == [("a", 3), ("b", 2), ("c", 4)] and len(kept.parts()) == 1
    assert before.count() == 2  # readers are not disturbed
    monkeypatch.setattr(Cache, "MOST_PARTS", 1)
    kept.merge(row(("d", 5)))
    assert len(have()) == kept.count() == 4 and len(kept.parts()) == 1


def test_only_pages_for_an_engine_are_rendered(pages):
    def render(todo):
        assert not todo.where("path = 'good.pdf'").count()
        return todo.withColumn("content", F.encode(F.concat(F.lit("page "), F.col("n").cast("string")), "utf-8"))

    got = by_page(recognize(pages, Options(engine="high"), render=render))
    assert got["bad.pdf", 2].text == "page 2" and got["good.pdf", 1].text == GOOD


# --- what a result depends on -------------------------------------------------------------------------------------


def scans(spark, content, modified="2024-01-01", **more):
    return spark.createDataFrame([("scan.pdf", n, "", bytearray(f"{content} {n}".encode())) for n in (1, 2)], "path string, n int, text string, content binary").withColumns({"modified": F.lit(modified), "length": F.lit(len(content))} | more)


def test_a_replaced_file_is_read_again(spark, tmp_path):
    kept = Cache(spark, str(tmp_path / "cache"))
    read = lambda df: {r.n: r.text for r in recognize(df, Options(engine="high"), cached=kept).collect()}
    assert read(scans(spark, "old scan")) == {1: "old scan 1", 2: "old scan 2"}
    assert read(scans(spark, "new scan")) == {1: "new scan 1", 2: "new scan 2"}

    def render(content):
        return lambda todo: todo.withColumn("content", F.encode(F.concat(F.lit(content), F.col("n").cast("string")), "utf-8"))

    bare = lambda when, size: scans(spark, "x", when, length=F.lit(size)).drop("content")
    for when, size, content, want in (("a", 1, "one", "one"), ("a", 1, "two", "one"), ("b", 1, "two", "two")):
        got = recognize(bare(when, size), Options(engine="high"), cached=kept, render=render(content)).collect()
        assert {r.text for r in got} == {f"{want}1", f"{want}2"}


def test_settings_of_services_are_part_of_the_key(spark, tmp_path):
    kept = Cache(spark, str(tmp_path / "cache"))
    df, calls = scans(spark, "scan"), []
    base = {"paddle_vl_server_url": "http://localhost:1", "paddle_vl_model": "a"}
    for more in ({}, {"paddle_vl_model": "b"}, {"psm": 6}, {"paddle_vl_model": " a "}):
        engines.register_engine("paddleocr-vl-mlx", reader(len(calls)), structured=True)
        recognize(df, Options(engine="paddleocr-vl-mlx", **(base | more)), cached=kept).collect()
        calls.append(kept.count())
    assert calls == [2, 4, 6, 6]
    vision = Options(engine="vision", vision_model="m", vision_url="u")
    from pagewright.plans.recognize import engine_context

    assert engine_context(vision) == engine_context(Options(engine="vision", vision_model=" m", vision_url="u ", vision_prompt=" \n"))
    assert engine_context(vision) != engine_context(Options(engine="vision", vision_model="m", vision_url="u", vision_prompt="p"))
    assert engine_context(Options(engine="tesseract", auto_escalate=("vision",))) and engine_context(Options(engine="tesseract", vision_model="m")) == ""


def test_a_service_reads_a_document_as_one_page(spark, tmp_path):
    read = reader(90)

    def service(batches):
        for b in read(batches):
            yield b.assign(markdown=b["text"])

    engines.register_engine("vision", service, structured=True)
    kept = Cache(spark, str(tmp_path / "cache"))
    for _ in range(2):
        (r,) = recognize(scans(spark, "scan"), Options(engine="vision"), cached=kept).collect()
        assert (r.n, r.source, r.mean_conf, r.flag, r.markdown) == (0, "vision", None, None, "## Page 1\n\nscan 1\n\n## Page 2\n\nscan 2") and r.text == r.markdown
        assert kept.count() == 1
        engines.register_engine("vision", reader(90, True), structured=True)
    engines.register_engine("vision", service, structured=True)
    got = recognize_images(scans(spark, "image").where("n = 1").select("path", "content"), Options(engine="vision")).collect()
    assert [(r.n, r.text) for r in got] == [(0, "## Page 1\n\nimage 1")]
    only = recognize(scans(spark, "scan"), Options(engine="vision", max_pages=1)).collect()
    assert [(r.n, r.text) for r in only] == [(0, "## Page 1\n\nscan 1")]
    engines._ENGINES.pop("vision")


# --- what is done to a page before and while it is read ---------------------------------------------------------------


@pytest.fixture
def program(tmp_path):
    """A recogniser that finds Cyrillic on pages that say so, and reads a page as the language it was asked for."""
    path = tmp_path / "recogniser"
    path.write_text('#!/bin/sh\ncase "$*" in *"-l osd"*) if grep -q cyrillic "$1"; then echo "Script: Cyrillic"; echo "Script confidence: 2.5"; fi;; *tsv) printf "h\\n1\\t1\\t1\\t1\\t1\\t1\\t5\\t6\\t7\\t8\\t91.5\\tword\\n";; *) echo "$4";; esac\n')
    path.chmod(0o755)
    return str(path)


def test_language_is_found_on_the_first_page_of_each_file(spark, program, monkeypatch):
    rows = [("a", 1, "", b"cyrillic"), ("a", 2, "", b"latin"), ("b", 2, "", b"cyrillic"), ("b", 1, "", b"latin")]
    df = spark.createDataFrame([(p, n, t, bytearray(c)) for p, n, t, c in rows], "path string, n int, text string, content binary")
    reports = engines.script_reports
    monkeypatch.setattr(engines, "script_reports", lambda images: reports(images, program))
    engines.register_engine("tesseract", engines.tesseract("eng", 3, program))
    try:
        got = {(r.path, r.n): r for r in recognize(df, Options()).collect()}
        assert {k: r.text for k, r in got.items()} == {("a", 1): "rus+eng", ("a", 2): "rus+eng", ("b", 1): "eng", ("b", 2): "eng"}
        r = got["a", 1]
        assert (r.mean_conf, r.words[0].text, list(r.words[0].bbox)) == (91.5, "word", [5, 6, 7, 8]) and r.elapsed_s >= 0
        assert {r.text for r in recognize(df, Options(lang="deu")).collect()} == {"deu"}
        monkeypatch.setattr(engines, "script_reports", lambda images: reports(images, "/no/such/program"))
        assert {r.text for r in recognize_images(df.where("n = 1").select("path", "content"), Options()).collect()} == {"eng"}
    finally:
        engines.register_engine("tesseract", engines.tesseract())


def test_images_are_prepared_at_the_level_asked_for(spark, monkeypatch):
    monkeypatch.setattr(preprocess, "preprocess", lambda content, level: F.concat(F.col(content), F.encode(F.concat(F.lit(" "), F.col(level)), "utf-8")))
    df = scans(spark, "scan").where("n = 1")
    read = lambda **o: recognize(df, Options(engine="high", **o)).first().text
    best = "enhanced" if find_spec("cv2") else "basic"
    assert [read(), read(preprocess="full"), read(preprocess="none")] == [f"scan 1 {best}", "scan 1 full", "scan 1"]
    images = df.select("path", "content")
    assert [recognize_images(images, Options(engine="high", preprocess=v)).first().text for v in ("auto", "basic")] == ["scan 1 none", "scan 1 basic"]
    engines.register_engine("paddleocr-vl-mlx", reader(90), structured=True)
    assert recognize(df, Options(engine="paddleocr-vl-mlx", preprocess="full")).first().text == "scan 1"
    engines._ENGINES.pop("paddleocr-vl-mlx")


def test_wide_pages_are_rendered_at_less(spark, monkeypatch):
    monkeypatch.setattr(documents, "rendered", lambda df: df.select("path", F.explode("pages").alias("n"), F.encode(F.col("dpi").cast("string"), "utf-8").alias("content"), F.lit(None).cast("string").alias("error")))
    files = spark.createDataFrame([(p, bytearray(b"x")) for p in "abcd"], "path string, content binary")
    signals = spark.createDataFrame([("a", 595.0), ("b", 900.0), ("c", 1920.0)], "path string, width double")
    todo = files.select("path", F.lit(1).alias("n"))
    got = {r.path: r.content.decode() for r in cli._renderer(files, Options(), signals)(todo).collect()}
    assert got == {"a": "300", "b": "200", "c": "150", "d": "300"}
    assert {r.content.decode() for r in cli._renderer(files, Options(dpi=72), signals)(todo).collect()} == {"72"}
    said = spark.createDataFrame([("Pages: 3\nPage size:      595.32 x 841.92 pts (A4)",), ("Page    1 size: 1920 x 1080 pts",), ("Pages: 1",), (None,)], "r string")
    assert [r[0] for r in said.select(probe.page_width("r")).collect()][::2] == [595.32, None]


class Pdf:
    """A PDF package that knows one file."""

    class Output:
        DICT = "dict"

    class Matrix:
        def __init__(self, x, y):
            self.x = x

    page_count, needs_pass = 2, False

    def __init__(self, texts=("one", "")):
        self.texts = texts

    def open(self, name):
        return self

    def __enter__(self):
        return self

    def __exit__(self, *a):
        pass

    def __iter__(self):
        return iter([Page(t) for t in self.texts])

    def __getitem__(self, i):
        return Page(self.texts[i])


class Page:
    def __init__(self, text):
        self.text = text
        self.rect = type("R", (), {"width": 900.0, "height": 500.0})()

    def get_text(self, kind):
        return self.text

    def get_pixmap(self, matrix):
        return type("P", (), {"tobytes": lambda own, kind: f"{self.text}@{matrix.x * 72:.0f}".encode()})()


def test_the_pdf_package_is_asked_before_the_programs(spark, monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "fitz", Pdf())
    text = documents.read_text("x.pdf")
    assert text == {"text": "one\f\f", "error": None}
    pages = documents.split_pages(spark.createDataFrame([("x", text["text"])], "path string, text string"))
    assert sorted((r.n, r.text) for r in pages.collect()) == [(1, "one"), (2, "")]
    assert documents.read_images("x.pdf", "", 144, [1]) == [{"n": 1, "content": b"one@144", "error": None}]
    assert [r["error"] for r in documents.read_images("x.pdf", "", 144, [2, 3])] == [None, "no such page"]
    info = spark.createDataFrame([(documents.read_info("x.pdf"),)], "r string").select(probe.document_info("r").alias("i"), probe.page_width("r").alias("w")).first()
    assert (info.i.pages, info.i.encrypted, info.w) == (2, False, 900.0)
    monkeypatch.setitem(sys.modules, "fitz", None)  # a package that can't be imported
    monkeypatch.setattr(documents, "_run", lambda call: ("by program", None))
    assert documents.read_text("x.pdf")["text"] == documents.read_info("x.pdf") == "by program"


class Recogniser:
    class Output:
        DICT = "dict"

    def __init__(self, **pages):
        self.pages, self.asked = pages, []

    def image_to_data(self, name, lang, config, output_type):
        self.asked.append((lang, config))
        words = self.pages[lang.replace("+", "_")]
        return {"text": [w for w, _ in words], "conf": [str(c) for _, c in words], **dict.fromkeys(("left", "top", "width", "height"), [1] * len(words))}

    def image_to_string(self, name, lang, config):
        return lang


@pytest.mark.parametrize(
    "lang, eng, both, want, mean",
    [
        ("eng", [("a", 60)], [("a", 60), ("b", 20)], "rus+eng", 40.0),  # more words
        ("eng", [("a", 60)], [("a", 66)], "rus+eng", 66.0),  # surer by more than five points
        ("eng", [("a", 60)], [("a", 65)], "eng", 60.0),
        ("eng", [], [], "eng", 0.0),
        ("eng", [("a", 60), (" ", 90), ("b", -1)], [("a", 61)], "eng", 60.0),  # blanks and -1 are no words
        ("deu", [("a", 60)], [("a", 99), ("b", 99)], "deu", 60.0),
    ],
)
def test_english_pages_are_read_again_as_russian_and_english(lang, eng, both, want, mean):
    package = Recogniser(eng=eng, deu=eng, rus_eng=both)
    got = engines.package_page(package, "x.png", lang, 6)
    assert (got["text"], got["mean_conf"]) == (want, mean)
    assert package.asked == [(x, "--oem 3 --psm 6") for x in ((lang, "rus+eng") if lang == "eng" else (lang,))]


def test_lines_are_read_by_a_model_of_their_language():
    import pandas as pd

    loaded = []
    run = engines._adapter(lambda model, path, n, content: {"text": model}, lambda lang: loaded.append(lang) or lang, engines.line_lang)
    got = list(run(iter([pd.DataFrame({"path": "x", "n": range(5), "content": b"", "lang": ["rus+eng", "RUS", None, "chi_sim", "xyz"]})])))
    assert got[0]["text"].tolist() == ["ru", "ru", "en", "ch", "en"] and loaded == ["ru", "en", "ch"]


# --- requirements -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "engine, caps, settings, code",
    [
        ("tesseract", {"bin_tesseract": ""}, {}, "missing_tesseract_binary"),
        ("tesseract", {"bin_tesseract": "/x"}, {}, "ok"),
        ("easyocr", {"has_easyocr": False}, {}, "missing_easyocr_package"),
        ("paddleocr", {"has_paddleocr": True, "has_paddle": False}, {}, "missing_paddle_runtime"),
        ("paddleocr", {"has_paddleocr": False, "has_paddle": False}, {}, "missing_paddleocr_package"),
        ("paddleocr-vl-mlx", {"has_paddleocr": True, "has_paddle": True, "has_doc_parser": False}, {}, "missing_paddleocr_doc_parser"),
        ("paddleocr-vl-mlx", {"has_paddleocr": True, "has_paddle": True, "has_doc_parser": True}, {}, "missing_paddle_vl_server_url"),
        ("paddleocr-vl-mlx", {"has_paddleocr": True, "has_paddle": True, "has_doc_parser": True}, {"paddle_vl_server_url": "http://example.com"}, "unsafe_paddle_vl_server_url"),
        ("paddleocr-vl-mlx", {"has_paddleocr": True, "has_paddle": True, "has_doc_parser": True}, {"paddle_vl_server_url": "http://[::1]:8111/"}, "missing_paddle_vl_model"),
        ("vision", {"has_openai": False}, {}, "missing_openai_package"),
        ("vision", {"has_openai": True}, {"vision_api_key": " "}, "missing_vision_api_key"),
        ("vision", {"has_openai": True}, {"vision_api_key": "k"}, "missing_vision_model"),
        ("vision", {"has_openai": True}, {"vision_api_key": "k", "vision_model": "m"}, "ok"),
        ("other", {}, {}, "unsupported_engine"),
    ],
)
def test_first_unmet_requirement(engine, caps, settings, code):
    got = R.engine_requirement(engine, settings, caps)
    assert got.code == code and got.available == (code == "ok") and got.record()["available"] == got.available
    if code != "ok":
        with pytest.raises(R.Unmet) as e:
            R.require(got)
        assert e.value.code == (R.BAD_ARGUMENTS if got.kind in ("configuration", "engine") else R.MISSING)


def test_pdf_requirements():
    none = {"has_fitz": False, "bin_pdftoppm": "", "bin_pdftotext": ""}
    assert R.pdf_requirement(None, none).code == "missing_pdf_render_backend" and R.pdf_requirement("text", none).code == "missing_pdf_text_backend"
    assert R.pdf_requirement(None, none | {"has_fitz": True}).available
    assert R.pdf_requirement(None, none | {"bin_pdftoppm": "/x"}).code == "missing_pdf_text_backend"


def test_loopback_and_vision_settings():
    assert [R.is_loopback(u) for u in ("http://localhost:1", "https://127.8.8.8/", "http://10.0.0.1", "ftp://localhost", "nonsense", "http://[bad")] == [True, True, False, False, False, False]
    assert R.vision_settings(" k ", " m ", " ") == ("k", "m", None)
    for bad in (("", "m"), ("k", " ")):
        with pytest.raises(R.Unmet):
            R.vision_settings(*bad)
    with pytest.raises(R.Unmet) as e, R.importing("easyocr", "easyocr"):
        raise ImportError("no", name="PIL.Image")
    assert e.value.requirement.components == ("pillow",)


def test_executors_are_probed(spark):
    got = {r.name: (r.found, r.probed) for r in R.cluster_capabilities(spark, 3).collect()}
    assert got["has_numpy"] == (3, 3) and got["bin_tesseract"][1] == 3


# --- sources and outputs ----------------------------------------------------------------------------------------


def test_pages_keep_their_numbers(spark):
    got = documents.split_pages(spark.createDataFrame([("a", "one\f\fthree\f"), ("b", "only"), ("c", None)], "path string, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, "one"), ("a", 2, ""), ("a", 3, "three"), ("b", 1, "only")]


def test_missing_programs_are_rows_not_exceptions(spark):
    df = spark.createDataFrame([("a.pdf", bytearray(b"%PDF"))], "path string, content binary")
    if not R.capabilities()["bin_pdftotext"]:
        assert documents.text_layer(df).first().error == "pdftotext is not installed"
    if not R.capabilities()["bin_pdftoppm"]:
        r = documents.rendered(df.withColumn("dpi", F.lit(150)).withColumn("pages", F.lit(None))).first()
        assert (r.n, r.error) == (None, "pdftoppm is not installed")
    if not R.capabilities()["bin_pdfinfo"]:
        assert documents.signals(df).first().pages is None
    if not R.capabilities()["bin_tesseract"]:
        with pytest.raises(PySparkException, match="not installed"):
            recognize_images(df.withColumn("path", F.lit("x.png")), Options(engine="tesseract"))


def test_images_pass_where_no_package_prepares_them(spark):
    df = spark.createDataFrame([(bytearray(b"no image"), v) for v in preprocess.LEVELS] + [(None, "full")], "c binary, v string")
    assert [r[0] for r in df.select(preprocess.preprocess("c", "v")).collect()] == [bytearray(b"no image")] * 4 + [None]


def test_a_set_is_written_whole_or_not(tmp_path, monkeypatch):
    a, b = tmp_path / "a.md", tmp_path / "sub" / "b.txt"
    outputs.write_set({str(a): "one", str(b): "two"})
    assert (a.read_text(), b.read_text()) == ("one", "two")
    move, count = os.replace, iter(range(99))

    def broken(x, y):
        if next(count) == 3:
            raise OSError("disk full")
        return move(x, y)

    monkeypatch.setattr(os, "replace", broken)
    with pytest.raises(R.Failure, match="disk full"):
        outputs.write_set({str(a): "new", str(b): "new"})
    monkeypatch.undo()
    assert (a.read_text(), b.read_text()) == ("one", "two")
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["a.md", "b.txt"]


def test_routing_and_lists(tmp_path):
    assert outputs.route({"md": "x"}, "/in/doc.pdf", str(tmp_path / "o.md")) == {str(tmp_path / "o.md"): "x"}
    assert outputs.route({"md": "x", "txt": "y"}, "/in/doc.pdf", "o") == {"o/doc.md": "x", "o/doc.txt": "y"}
    assert outputs.route({"md": "x"}, "/in/doc.pdf", str(tmp_path)) == {str(tmp_path / "doc.md"): "x"}
    assert outputs.parse_list("txt, all,md", outputs.FORMATS, "format", "all") == ("txt", "md", "json")
    for bad in ("", "md,,txt", "pdf"):
        with pytest.raises(R.Failure):
            outputs.parse_list(bad, outputs.FORMATS, "format", "all")
    assert outputs.same_stems(["/a/Café.pdf", "/b/café.png", "/c/x.pdf"]) == ["Café", "café"] or len(outputs.same_stems(["/a/Café.pdf", "/b/CAFÉ.png"])) == 2


def test_records(spark, tmp_path):
    got = probe.probe_images(spark.createDataFrame([("x.png",)], "path string"))
    outputs.write_records(got, str(tmp_path / "r"))
    line = next(p for p in (tmp_path / "r").iterdir() if p.name.startswith("part") and p.stat().st_size).read_text()
    assert json.loads(line)["needs_ocr"] is True and "readability" not in json.loads(line)


# --- frames and commands ----------------------------------------------------------------------------------------


@pytest.fixture
def payload(tmp_path):
    names = []
    for i, text in enumerate(("first frame", "second frame")):
        p = tmp_path / f"f{i}.png"
        p.write_bytes(text.encode())
        names.append(str(p))
    return {"outputDir": str(tmp_path), "strategy": "fps", "video": {}, "extraction": {}, "frames": [{"path": names[1], "timestampSeconds": 1.5}, {"path": names[0], "bytes": 7}]}


def test_frames_become_one_document(spark, payload, tmp_path):
    path = frame_sink.sink(spark, payload, Options(engine="high", vision_prompt="secret"))
    doc = json.loads(path.read_text())
    assert path == tmp_path / "ocr.json" and [f["index"] for f in doc["frames"]] == [0, 1]
    assert [f["pages"][0]["text"] for f in doc["frames"]] == ["second frame", "first frame"]
    assert doc["frames"][0]["timestampSeconds"] == 1.5 and doc["frames"][0]["bytes"] == len("second frame") and doc["frames"][1]["bytes"] == 7
    assert doc["text"] == "\n\n".join(f["text"] for f in doc["frames"]) and doc["markdown"].startswith("## Frame 1\n\n# f1.png\n\n## Page 1\n\nsecond frame\n")
    assert "secret" not in path.read_text() and doc["schemaVersion"] == 1


@pytest.mark.parametrize("change", [{"outputDir": "relative"}, {"outputDir": "/no/such/folder"}, {"strategy": "other"}, {"video": 1}, {"extraction": None}, {"frames": []}, {"frames": [1]}, {"frames": [{"path": ""}]}, {"frames": [{"path": "/no/such"}]}])
def test_bad_payloads(payload, change):
    with pytest.raises(R.Failure) as e:
        frames.check_payload(payload | change)
    assert e.value.code == R.BAD_ARGUMENTS


@pytest.mark.parametrize("raw", ["", "  ", "{", "[1]"])
def test_payloads_that_are_no_objects(raw):
    with pytest.raises(R.Failure):
        frames.parse_payload(raw)


@pytest.fixture
def as_tesseract(monkeypatch):
    monkeypatch.setattr(cli, "ready", lambda *a: engines.register_engine("tesseract", reader(50)))
    yield
    engines.register_engine("tesseract", engines.tesseract())


def test_ocr_command(spark, tmp_path, as_tesseract, capsys):
    for name in ("a.png", "b.jpg"):
        (tmp_path / name).write_bytes(f"words of {name}".encode())
    cli.ocr([str(tmp_path / "a.png"), str(tmp_path / "b.jpg"), str(tmp_path / "gone.png"), "--format", "all", "--out", str(tmp_path / "out")], spark)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.json", "a.md", "a.txt", "b.json", "b.md", "b.txt"]
    assert (tmp_path / "out" / "a.md").read_text() == "# a.png\n\n## Page 1\n\nwords of a.png\n"
    assert json.loads((tmp_path / "out" / "b.json").read_text())["report"] == {"total_pages": 1, "low_conf_pages": [1], "recommend_vision": [1]}
    err = capsys.readouterr().err
    assert "gone.png" in err and "a.png page 1: confidence 50.0, review-vision" in err
    cli.ocr([str(tmp_path / "a.png"), "--format", "txt"], spark)
    assert capsys.readouterr().out == "----- Page 1 -----\nwords of a.png\n\n"


def test_probe_command(spark, tmp_path, capsys):
    (tmp_path / "a.png").write_bytes(b"x")
    cli.ocr([str(tmp_path / "a.png"), "--probe"], spark)
    assert json.loads(capsys.readouterr().out)["reason"] == "image input requires OCR"
    (tmp_path / "a.doc").write_bytes(b"x")
    with pytest.raises(R.Failure) as e:
        cli.ocr([str(tmp_path / "a.doc"), "--probe"], spark)
    assert e.value.code == R.UNSUPPORTED and json.loads(capsys.readouterr().out)["status"] == "error"


@pytest.mark.parametrize("argv", [["x.png", "--probe"], ["FILE", "--probe", "--engine", "vision"], ["FILE", "FILE", "--format", "json"], ["FILE", "FILE", "--out", "o"], ["FILE", "FILE", "--searchable-pdf", "o"], ["FILE", "--format", "pdf"], ["FILE", "--vision-prompt", "p"]])
def test_command_line_errors(spark, tmp_path, argv):
    (tmp_path / "a.png").write_bytes(b"x")
    with pytest.raises(SystemExit) as e:
        cli.ocr([str(tmp_path / "a.png") if a == "FILE" else a for a in argv], spark)
    assert e.value.code == 2


def test_settings_by_flag_then_environment_then_default():
    args = cli.ocr_parser().parse_args(["x", "--dpi", "72", "--auto-escalate", "vision,tesseract,vision"])
    got = cli.configured(args, {"P_ENGINE": "tesseract", "P_DPI": "300", "P_LANG": "rus", "P_TIMEOUT": "2.5"}, "P")
    assert (got.engine, got.dpi, got.lang, got.timeout, got.auto_escalate, got.psm) == ("tesseract", 72, "rus", 2.5, ("vision",), 3)
    for bad in ({"P_ENGINE": "other"}, {"P_PSM": "x"}, {"P_TIMEOUT": "-1"}, {"P_TIMEOUT": "nan"}, {"P_AUTO_ESCALATE": "no"}, {"P_VISION_PROMPT": "a", "P_VISION_PROMPT_FILE": "b"}, {"P_VISION_PROMPT_FILE": "/no/such"}):
        with pytest.raises(R.Failure):
            cli.configured(cli.ocr_parser().parse_args(["x"]), bad, "P")


def test_frames_command_and_exit_codes(spark, payload, tmp_path, as_tesseract, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps(payload)))
    assert cli.main(["frames", "--output", str(tmp_path / "o.json")]) == R.OK
    assert json.loads((tmp_path / "o.json").read_text())["engine"] == "tesseract"
    monkeypatch.setattr("sys.stdin", io.StringIO(""))
    assert cli.main(["frames"]) == R.BAD_ARGUMENTS
    assert cli.main(["nothing"]) == R.BAD_ARGUMENTS
    monkeypatch.undo()
    if not R.capabilities()["bin_tesseract"]:
        assert cli.main(["ocr", str(tmp_path / "f0.png")]) == R.MISSING


def test_handoff(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    (said,) = cli.handoff([str(tmp_path / "a.png"), "--vision-prompt", "Read it"], spark)
    assert "Read it" in said and f"  Page 1: {tmp_path / 'a.png'}" in said
    with pytest.raises(SystemExit):
        cli.handoff([str(tmp_path / "a.png"), "--pages", "1"], spark)


def test_a_service_is_one_page_0_a_file(spark):
    df = spark.createDataFrame([("f", 2, "b"), ("f", 1, "a")], "path string, n int, markdown string")
    r = engines.whole_documents(df).first()
    assert (r.n, r.markdown) == (0, "## Page 1\n\na\n\n## Page 2\n\nb")


def test_exports():
    assert all(hasattr(api, n) for n in api.__all__)


# --- streams ----------------------------------------------------------------------------------------------------


def test_stream_triage_equals_batch(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("string").alias("path"), (F.col("turn") + 1).cast("int").alias("n"), "text")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    streams.triage_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = probe.probe_pdfs(rows)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_stream_windows(spark, tmp_path):
    rows = spark.sql(f"SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, CASE WHEN id % 3 = 0 THEN '??' ELSE '{GOOD}' END AS text FROM range(60)")
    rows.write.parquet(str(tmp_path / "in"))
    q = streams.quality_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r)[1:3] for r in spark.sql("SELECT * FROM windows ORDER BY start").collect()]
    assert got == [(10, 6), (10, 7), (10, 7)] * 2


def test_engines_get_pages_by_bytes(spark):
    """A batch of Spark's has 10,000 pages; their words as Python objects would fill an executor's memory."""
    most = 1 << 18

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"path": b["path"], "n": b["n"], "text": b["text"], "markdown": None, "mean_conf": float(len(b)), "words": [[] for _ in range(len(b))], "error": None})

    engines.register_engine("counting", run)
    text = F.when(F.col("id") == 7, F.repeat(F.lit("y"), 3 * most)).when(F.col("id") % 5 != 0, F.repeat(F.lit("x"), 4096))
    pages = spark.range(2000).coalesce(1).select(F.lit("a").alias("path"), F.col("id").cast("int").alias("n"), text.alias("text"))
    got = {r.n: r for r in engines.apply(pages, "counting").collect()}
    assert sorted(got) == list(range(2000))
    assert got[0].text is None and len(got[7].text) == 3 * most
    assert got[7].mean_conf == 1 and max(r.mean_conf for r in got.values()) <= 2 * most / 4096
