"""The workflow: triage, text layer or engine, flags, escalation of flagged pages, final pages.

Triage filters before any engine runs: Spark cannot push a filter through an engine. Engine output is written before
it is used twice, or the engine would run twice.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from importlib.util import find_spec

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import codes, engines, preprocess
from pagewright.functions.text import DEFAULT_PROMPT, cleanup
from pagewright.operators import cache as caching
from pagewright.operators import escalate, pagesets, probe, quality

PAGE = ["path", "n"]
COLUMNS = ["path", "n", "source", "mean_conf", "flag", "text", "markdown", "issues", "words", "skipped", "skip_reason", "decision", "elapsed_s"]
#: Engines that read whole documents get images as they are, and others images prepared; these read by language.
AS_THEY_ARE, BY_LANGUAGE = ("vision", "paddleocr-vl-mlx"), ("tesseract", "paddleocr")
_WORDS = "array<struct<text:string,conf:int,bbox:array<int>>>"
_DECISION = "struct<baseline:string,flag_reason:array<string>,attempts:array<struct<engine:string,status:string,mean_conf:double>>,selected:string>"


@dataclass(frozen=True)
class Options:
    engine: str = "tesseract"
    lang: str = "auto"
    dpi: int = 0
    preprocess: str = "auto"
    pages: str = ""
    max_pages: int = 0
    psm: int = 3
    min_conf: float = quality.MIN_CONF
    no_cleanup: bool = False
    force: bool = False
    skip_ocr: bool = False
    auto_escalate: tuple[str, ...] = ()
    vision_prompt: str = ""
    vision_model: str = ""
    vision_url: str = ""
    paddle_vl_server_url: str = ""
    paddle_vl_model: str = ""
    timeout: float | None = None


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _shaped(pages: DataFrame) -> DataFrame:
    have = {"mean_conf": "double", "flag": "string", "text": "string", "markdown": "string", "issues": "array<string>", "words": _WORDS, "skipped": "boolean", "skip_reason": "string", "decision": _DECISION, "elapsed_s": "double"}
    for c, kind in have.items():
        if c not in pages.columns:
            pages = pages.withColumn(c, F.lit(False) if c == "skipped" else F.array().cast(kind) if kind.startswith("array") else _none(kind))
    return pages.select(COLUMNS)


def text_layer_branch(pages: DataFrame, probed: DataFrame, no_cleanup: bool = False) -> DataFrame:
    """Pages of files whose text layer is usable, at full confidence."""
    usable = probed.where("has_text_layer").select("path")
    text = F.col("text") if no_cleanup else cleanup("text")
    return pages.join(usable, "path", "left_semi").select("path", "n", F.lit("text_layer").alias("source"), F.lit(100.0).alias("mean_conf"), text.alias("text"))


_local: dict[str, str] = {}


def shared_dir(spark) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and Spark is local."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local:
        _local[application] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _local[application]


def written(df: DataFrame, what: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def engine_context(options: Options) -> str:
    """What the engines of the chain depend on besides the page and the other options, as JSON; empty for nothing."""
    known = {
        "vision": {"model": options.vision_model.strip(), "prompt": options.vision_prompt if options.vision_prompt.strip() else DEFAULT_PROMPT, "url": options.vision_url.strip()},
        "paddleocr-vl-mlx": {"model": options.paddle_vl_model.strip(), "url": options.paddle_vl_server_url.strip()},
    }
    mine = {e: known[e] for e in (options.engine, *options.auto_escalate) if e in known}
    return json.dumps(mine, ensure_ascii=False, sort_keys=True) if mine else ""


def keyed(todo: DataFrame, options: Options) -> DataFrame:
    """todo (path, n, text, level) with ``key``, of all that a page's result depends on: the file as its time, length
    and content say, as far as there are such columns, the page, its text, the options and the engines' settings."""
    of = lambda c, value: value if c in todo.columns else F.lit("")
    key = codes.cache_key("path", of("modified", F.col("modified")), of("length", F.col("length")), F.lit(options.engine), F.lit(str(options.dpi)), "level", F.lit(options.lang), F.col("n").cast("string"), F.lit(engine_context(options)))
    fields = {f"_{f}": F.lit(str(getattr(options, f))) for f in ("psm", "min_conf", "no_cleanup", "auto_escalate")}
    made = todo.withColumns(fields).withColumn("key", F.sha1(F.concat_ws("|", key, codes.workflow_key(*fields), F.sha1("text"), of("content", F.sha1("content")))))
    made = made.drop(*fields)
    if options.engine != "vision":
        return made
    whole = made.groupBy("path").agg(F.sha1(F.array_join(F.array_sort(F.collect_list("key")), "")).alias("key"))  # one result a file
    return made.drop("key").join(whole, "path")


def _with_language(pages: DataFrame, options: Options) -> DataFrame:
    """pages with ``lang``: the one asked for, or by the script of the first page of each file that there is."""
    if options.lang != "auto":
        return pages.withColumn("lang", F.lit(options.lang))
    if "content" not in pages.columns or not {options.engine, *options.auto_escalate} & {*BY_LANGUAGE}:
        return pages
    first = pages.groupBy("path").agg(F.min_by("content", "n").alias("content"))
    told = engines.script_reports(first).select(F.col("path").alias("_path"), codes.detected_lang("report").alias("lang"))
    return pages.join(told, F.col("path") == F.col("_path"), "left").drop("_path").withColumn("lang", F.coalesce("lang", F.lit("eng")))


def _level(options: Options, kind: str, needs_ocr: Column) -> Column:
    able = all(find_spec(m) is not None for m in ("cv2", "numpy"))
    return codes.preprocess_level(F.lit(options.preprocess), F.lit(kind), needs_ocr, F.lit(able))


def _recognized(pages: DataFrame, engine: str, options: Options) -> DataFrame:
    if engine not in AS_THEY_ARE and {"content", "level"} <= {*pages.columns} and options.preprocess != "none":
        pages = pages.withColumn("content", preprocess.preprocess("content", "level"))
    pages = pages.select(*(c for c in ("path", "n", "text", "content", "lang") if c in pages.columns))
    got = engines.apply(pages.repartition("path", "n"), engine)  # pages of a file are spread
    got = got.withColumn("_stop", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit(engine + ": "), F.col("error"))).cast("string")))
    text = F.col("text") if options.no_cleanup else cleanup("text")
    structured = engines.engine(engine).structured
    issues = F.array().cast("array<string>") if structured else quality.issues("mean_conf", "words", options.min_conf)
    got = got.withColumn("issues", F.when(F.col("_stop").isNull(), issues))
    conf = _none("double") if structured else F.round("mean_conf", 1)
    return got.select("path", "n", F.lit(engine).alias("source"), conf.alias("mean_conf"), quality.flag("issues").alias("flag"), (F.col("text") if structured else text).alias("text"), "markdown", "issues", "words", "elapsed_s")


def _based(pages: DataFrame, options: Options) -> DataFrame:
    """What the first engine makes of the pages; a vision service's pages of a file are one, page 0."""
    base = _recognized(pages, options.engine, options)
    if options.engine != "vision":
        return written(base, "recognized")
    whole = engines.whole_documents(written(base, "recognized"))
    return written(_shaped(whole.withColumn("source", F.lit("vision"))), "documents")


def recognize(pages: DataFrame, options: Options | None = None, signals: DataFrame | None = None, cached: caching.Cache | None = None, render: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Final pages of the files whose pages (path, n, text, and content where an engine needs it) are given.

    ``render`` adds content to the pages that go to an engine, and only to those. With a cache, the pages should tell
    the file's ``modified`` and ``length``, or have its content, so that a file that was replaced is read again.
    An encrypted file, an engine error and an escalation that comes to nothing raise an error; then nothing is
    cached.
    """
    options = options or Options()
    spark = pages.sparkSession
    probed = written(probe.probe_pdfs(pages, signals), "probe")
    blocked = probed.where("status = 'blocked'").select("path", "reason").head(1)
    if blocked:
        raise ValueError(f"{blocked[0].path}: {blocked[0].reason}")
    ranges = probed.select("path", pagesets.selected(pagesets.resolve_range(F.lit(options.pages), "pages", F.lit(options.max_pages)), "pages").alias("_ns"))
    chosen = pages.join(ranges, "path").where(F.array_contains("_ns", F.col("n"))).drop("_ns")
    need = F.col("needs_ocr") | F.lit(options.force)
    layer = probed.where(~need) if options.force else probed
    text = _shaped(text_layer_branch(chosen, layer, options.no_cleanup))
    todo = chosen.join(probed.where(need).select("path", "text_layer_rejected", _level(options, "pdf", F.col("needs_ocr")).alias("level")), "path")
    if options.skip_ocr:
        rows = todo.select("path", "n", F.lit("skipped").alias("source"), F.lit("").alias("text"), F.lit(True).alias("skipped"), F.lit("needs OCR, which is switched off").alias("skip_reason"))
        return text.unionByName(_shaped(rows))
    keep = cached is not None and not options.force
    keys = keyed(todo, options) if keep else todo.withColumn("key", _none("string"))
    known = None
    if keep:
        kept = cached.load(_kept_schema())
        known = caching.hits(keys.select("key").distinct(), kept).select(COLUMNS)
        keys = caching.misses(keys, kept)
    if render is not None:
        keys = written(render(keys), "rendered")
    keys = _with_language(keys, options)
    base = _based(keys, options)
    final = _escalated(keys, base, options) if options.auto_escalate else _shaped(base)
    marks = keys.select("path", "n", "text_layer_rejected", "key")
    if options.engine == "vision":
        marks = marks.withColumn("n", F.lit(0)).distinct()
    final = final.join(marks, PAGE).withColumn("issues", quality.stamp_rejected("issues", "text_layer_rejected"))
    fresh = written(final.select(*COLUMNS, "key"), "final")
    if keep:
        cached.merge(fresh)
    out = text.unionByName(fresh.select(COLUMNS))
    return out.unionByName(known) if known is not None else out


def recognize_images(images: DataFrame, options: Options | None = None) -> DataFrame:
    """Final pages of image files (path, content): each is one page that always needs OCR."""
    options = options or Options()
    pages = images.select("path", F.lit(1).alias("n"), F.lit("").alias("text"), "content")
    if options.skip_ocr:
        rows = pages.select("path", "n", F.lit("skipped").alias("source"), "text", F.lit(True).alias("skipped"), F.lit("needs OCR, which is switched off").alias("skip_reason"))
        return _shaped(rows)
    pages = _with_language(pages.withColumn("level", _level(options, "image", F.lit(True))), options)
    base = _based(pages, options)
    return written(_escalated(pages, base, options), "final") if options.auto_escalate else _shaped(base)


def _kept_schema():
    from pyspark.sql.types import StructType

    kinds = {"path": "string", "n": "int", "source": "string", "mean_conf": "double", "flag": "string", "text": "string", "markdown": "string", "issues": "array<string>", "words": _WORDS, "skipped": "boolean", "skip_reason": "string", "decision": _DECISION, "elapsed_s": "double", "key": "string"}
    return StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in kinds.items()))


def _escalated(pages: DataFrame, base: DataFrame, options: Options) -> DataFrame:
    """base with flagged pages replaced by what the chain of engines made of them, each with its decision."""
    flagged = base.where("flag is not null").select(PAGE)
    again = pages.join(flagged, PAGE, "left_semi")
    rows = base.join(flagged, PAGE, "left_semi").withColumn("i", F.lit(0))
    for i, engine in enumerate(options.auto_escalate, 1):
        got = _recognized(again, engine, options)
        empty = (F.trim(F.coalesce("text", F.lit(""))) == "") & (F.trim(F.coalesce("markdown", F.lit(""))) == "") & (F.size("words") <= 0)
        got = got.withColumn("text", F.when(empty, F.raise_error(F.lit(f"{engine} returned nothing")).cast("string")).otherwise(F.col("text")))
        rows = rows.unionByName(got.withColumn("i", F.lit(i)))
    rows = written(rows.withColumns({"engine": F.col("source"), "n_words": F.size("words")}), "attempts")
    reasons = rows.where("i = 0").select(*PAGE, quality.flag_reasons("issues", "mean_conf", "words", "flag", options.min_conf).alias("flag_reason"))
    chosen = escalate.select(rows, PAGE).join(reasons, PAGE).join(rows.withColumn("selected_i", F.col("i")).drop("i", "engine"), [*PAGE, "selected_i"])
    chosen = chosen.withColumn("decision", F.struct("baseline", "flag_reason", "attempts", F.col("selected").alias("selected")))
    return escalate.merge_selected(_shaped(base), _shaped(chosen), PAGE, [c for c in COLUMNS if c not in PAGE])
