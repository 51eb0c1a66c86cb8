"""Three commands: ``ocr`` (triage or recognise files), ``frames`` (recognise a payload's frames) and ``handoff``
(render pages and say what to read). All inputs of a command are one Spark job; outputs are committed a file at a time.
"""

from __future__ import annotations

import argparse
import json
import math
import os
import sys
import tempfile
from collections.abc import Mapping
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import engines, requirements
from pagewright.functions.codes import auto_dpi
from pagewright.functions.requirements import Failure
from pagewright.functions.text import DEFAULT_PROMPT
from pagewright.operators import cache, outputs, pagesets, probe, render
from pagewright.plans import frame_sink
from pagewright.plans.recognize import Options, recognize, recognize_images, written
from pagewright.sources import documents, frames

ENGINES = ("tesseract", "easyocr", "paddleocr", "paddleocr-vl-mlx", "vision")
LEVELS = ("none", "basic", "enhanced", "full", "auto")
SERVICES = ("vision_api_url", "vision_api_key", "vision_model", "paddle_vl_server_url", "paddle_vl_model")
IMAGES = {".bmp", ".gif", ".heic", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp"}


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def kind(path: str) -> str:
    suffix = Path(path).suffix.lower()
    return "pdf" if suffix == ".pdf" else "image" if suffix in IMAGES else "unsupported"


def _checked(parse):
    def run(value: str):
        try:
            return parse(value)
        except Failure as e:
            raise argparse.ArgumentTypeError(str(e)) from e

    return run


engine_list = _checked(lambda v: outputs.parse_list(v, ENGINES, "engine"))
format_list = _checked(lambda v: outputs.parse_list(v, outputs.FORMATS, "format", "all"))


def _shared(p: argparse.ArgumentParser, prompts: bool = True) -> None:
    p.add_argument("--engine", choices=ENGINES)
    p.add_argument("--lang")
    p.add_argument("--dpi", type=int)
    p.add_argument("--preprocess", choices=LEVELS)
    p.add_argument("--psm", type=int)
    p.add_argument("--min-conf", type=float)
    p.add_argument("--timeout", type=float, help="seconds for a request to a service")
    for s in SERVICES:
        p.add_argument("--" + s.replace("_", "-"))
    g = p.add_mutually_exclusive_group()
    g.add_argument("--vision-prompt")
    g.add_argument("--vision-prompt-file", type=Path)


def ocr_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ocr", description="Text of PDFs and images: the text layer where it can be trusted, recognition where not.")
    p.add_argument("inputs", nargs="+", metavar="INPUT")
    p.add_argument("--probe", action="store_true", help="print a JSON record an input and stop")
    p.add_argument("--format", type=format_list, default=("md",), help="of md, txt, json; or all")
    p.add_argument("--out", default="", help="a file, or a folder where there are several")
    p.add_argument("--pages", default="", help="such as 1-3,5")
    p.add_argument("--max-pages", type=int, default=0)
    p.add_argument("--cache", default="", help="folder of cached results")
    p.add_argument("--auto-escalate", type=engine_list)
    p.add_argument("--searchable-pdf", default="")
    for flag in ("force", "skip-ocr", "no-cleanup", "verbose"):
        p.add_argument("--" + flag, action="store_true")
    _shared(p)
    return p


def _prompt(args, env_text: str = "", env_file: str = "") -> str:
    if args.vision_prompt is not None:
        return args.vision_prompt
    if args.vision_prompt_file is None and env_text and env_file:
        raise Failure("a prompt and a prompt file are both set")
    path = args.vision_prompt_file or (Path(env_file) if env_file else None)
    if path is None:
        return env_text
    try:
        return path.read_text(encoding="utf-8")
    except (OSError, UnicodeError) as e:
        raise Failure(f"the prompt file can't be read: {path}") from e


def configured(args, env: Mapping[str, str], prefix: str) -> Options:
    """Options by flag, else environment, else default."""

    def get(name: str, default, cast=str):
        given = getattr(args, name, None)
        if given is not None:
            return given
        raw = env.get(f"{prefix}_{name.upper()}", "").strip()
        if not raw:
            return default
        try:
            return cast(raw)
        except (TypeError, ValueError, Failure) as e:
            raise Failure(f"{prefix}_{name.upper()} has no valid value") from e

    def one_of(known):
        return lambda v: known[known.index(v)]

    base = Options()
    engine = get("engine", base.engine, one_of(ENGINES))
    chain = get("auto_escalate", (), lambda v: outputs.parse_list(v, ENGINES, "engine"))
    timeout = get("timeout", None, float)
    if timeout is not None and not (math.isfinite(timeout) and timeout > 0):
        raise Failure("the timeout must be a positive number of seconds")
    return Options(
        engine=engine, auto_escalate=tuple(e for e in chain if e != engine), lang=get("lang", base.lang), dpi=get("dpi", 0, int), preprocess=get("preprocess", base.preprocess, one_of(LEVELS)),
        psm=get("psm", base.psm, int), min_conf=get("min_conf", base.min_conf, float), timeout=timeout, pages=getattr(args, "pages", ""), max_pages=getattr(args, "max_pages", 0),
        force=getattr(args, "force", False), skip_ocr=getattr(args, "skip_ocr", False), no_cleanup=getattr(args, "no_cleanup", False),
        vision_prompt=_prompt(args, env.get(f"{prefix}_VISION_PROMPT", ""), env.get(f"{prefix}_VISION_PROMPT_FILE", "")), vision_model=get("vision_model", ""), vision_url=get("vision_api_url", ""),
        paddle_vl_server_url=get("paddle_vl_server_url", ""), paddle_vl_model=get("paddle_vl_model", ""),
    )


def ready(options: Options, services: Mapping[str, str], caps=None) -> None:
    """Every engine of the chain must have what it needs; those with settings are registered with them."""
    for e in (options.engine, *options.auto_escalate):
        requirements.require(requirements.engine_requirement(e, services, caps))
        if e == "vision":
            engines.register_engine(e, engines.vision(services["vision_api_key"], services["vision_model"], services.get("vision_api_url") or "", options.vision_prompt, options.timeout), structured=True)
        elif e == "paddleocr-vl-mlx":
            engines.register_engine(e, engines.paddleocr_vl(services["paddle_vl_server_url"], services["paddle_vl_model"]), structured=True)
        elif e == "tesseract":
            engines.register_engine(e, engines.tesseract("eng" if options.lang == "auto" else options.lang, options.psm))


def _services(args) -> dict[str, str]:
    return {s: getattr(args, s) or "" for s in SERVICES}


def probed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One triage row an input."""
    pdfs = [p for p in paths if kind(p) == "pdf"]
    images = spark.createDataFrame([(p,) for p in paths if kind(p) == "image"], "path string")
    got = probe.probe_images(images)
    if pdfs:
        requirements.require(requirements.pdf_requirement("text"))
        files = _named(documents.files(spark, *pdfs))
        got = probe.probe_pdfs(_pages(files), documents.signals(files).drop("pages")).unionByName(got)
    return got


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))


def _pages(files: DataFrame) -> DataFrame:
    text = documents.text_layer(files)
    stop = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "error")).cast("string")).otherwise(F.col("text"))
    return documents.split_pages(text.select("path", stop.alias("text")))


def _renderer(files: DataFrame, options: Options, signals: DataFrame):
    def run(todo: DataFrame) -> DataFrame:
        wanted = todo.groupBy("path").agg(F.sort_array(F.collect_set("n")).alias("pages"))
        wide = signals.select("path", "width")
        dpi = F.lit(options.dpi) if options.dpi else auto_dpi("width", F.lit("pdf"))
        images = documents.rendered(files.join(wanted, "path").join(wide, "path", "left").withColumn("dpi", dpi))
        images = images.withColumn("content", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "error")).cast("binary")).otherwise(F.col("content")))
        return todo.join(images.drop("error"), ["path", "n"])

    return run


def pages_of(spark: SparkSession, paths: list[str], options: Options, kept: cache.Cache | None = None) -> DataFrame:
    """Final pages of PDFs and images."""
    parts = []
    images, pdfs = [p for p in paths if kind(p) == "image"], [p for p in paths if kind(p) == "pdf"]
    if images:
        parts.append(recognize_images(_named(documents.files(spark, *images)), options))
    if pdfs:
        requirements.require(requirements.pdf_requirement("text"))
        files = _named(documents.files(spark, *pdfs))
        signals = written(documents.signals(files), "signals")
        pages = _pages(files).join(files.select("path", "modified", "length"), "path")
        parts.append(recognize(pages, options, signals.drop("pages"), kept, _renderer(files, options, signals)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def rendered_documents(pages: DataFrame, options: Options, formats: tuple[str, ...]) -> dict[str, dict[str, str]]:
    """Contents by path and format."""
    meta = {"engine": options.engine, "lang": "auto-detected" if options.lang == "auto" else options.lang, "dpi": options.dpi, "preprocess": options.preprocess}
    made = {"md": lambda: render.to_markdown(pages, markdown="markdown"), "txt": lambda: render.to_text(pages), "json": lambda: render.to_json(pages, meta, least=options.min_conf)}
    out: dict[str, dict[str, str]] = {}
    for f in formats:
        for path, content in made[f]().collect():  # a document an input, all of them named on the command line
            out.setdefault(path, {})[f] = content
    return out


def ocr(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = ocr_parser()
    args = parser.parse_args(argv)
    there = [os.path.abspath(p) for p in args.inputs if os.path.exists(p)]
    gone = [p for p in args.inputs if not os.path.exists(p)]
    if args.probe:
        clash = [n for n, v in (("--engine", args.engine), ("--out", args.out), ("--searchable-pdf", args.searchable_pdf), ("--auto-escalate", args.auto_escalate), ("engine settings", any(_services(args).values()) or args.vision_prompt or args.vision_prompt_file)) if v]
        if clash:
            parser.error(f"--probe goes without {', '.join(clash)}")
        if gone:
            parser.error(f"not found: {gone[0]}")
    elif len(args.inputs) > 1:
        same = outputs.same_stems(args.inputs) if args.out else []
        if args.searchable_pdf:
            parser.error("--searchable-pdf takes one input")
        if not args.out and "json" in args.format:
            parser.error("JSON of several inputs needs --out")
        if same:
            parser.error(f"these inputs would be written to one file: {', '.join(same)}")
    for p in there:
        if kind(p) == "unsupported":
            why = f"unsupported file type: {p}"
            if args.probe:
                print(json.dumps({"path": p, "input_type": "unsupported", "status": "error", "needs_ocr": False, "reason": why}, ensure_ascii=False))
            raise Failure(why, requirements.UNSUPPORTED)
    if args.probe:
        for record in probed(spark or session(), there).toJSON().collect():
            print(record)
        return
    options = configured(args, os.environ, "PAGEWRIGHT")
    if (args.vision_prompt or args.vision_prompt_file) and "vision" not in (options.engine, *options.auto_escalate):
        parser.error("a vision prompt needs the vision engine, first or in the chain")
    for p in gone:
        print(f"ocr: not found, left out: {p}", file=sys.stderr)
    if not there:
        return
    if not options.skip_ocr:
        ready(options, _services(args))
    spark = spark or session()
    pages = pages_of(spark, there, options, cache.Cache(spark, args.cache) if args.cache else None)
    made = rendered_documents(pages, options, args.format)
    for p in there:
        contents = made.get(p, {})
        if args.out:
            files = outputs.route(contents, p, args.out, len(args.inputs)) if contents else {}
            outputs.write_set(files)
            for f in files:
                print(f"ocr: wrote {f}", file=sys.stderr)
        else:
            for f, c in contents.items():
                print((f"--- {f} ---\n" if len(contents) > 1 else "") + c)
    if args.searchable_pdf and (why := outputs.searchable_pdf(there[0], args.searchable_pdf, options.lang)):
        print(f"ocr: {why}", file=sys.stderr)
    for r in pages.where("flag is not null").select("path", "n", "mean_conf", "flag").orderBy("path", "n").toLocalIterator():
        print(f"ocr: {r.path} page {r.n}: confidence {r.mean_conf}, {r.flag}", file=sys.stderr)


def frames_command(argv: list[str] | None = None, stdin=None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="frames", description="Recognise the frames of a JSON payload on standard input.")
    parser.add_argument("--auto-escalate", type=engine_list)
    parser.add_argument("--output")
    _shared(parser)
    args = parser.parse_args(argv)
    env = os.environ
    options = configured(args, env, "PAGEWRIGHT_FRAMES")
    services = {s: getattr(args, s) or env.get(f"PAGEWRIGHT_FRAMES_{s.upper()}", "") for s in SERVICES}
    payload = frames.parse_payload((stdin or sys.stdin).read())
    frames.check_payload(payload)
    ready(options, services)
    frame_sink.sink(spark or session(), payload, replace(options, force=False), args.output or env.get("PAGEWRIGHT_FRAMES_OUTPUT") or None)


def handoff(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Manifests of the inputs; rendered pages stay where they are said to be."""
    parser = argparse.ArgumentParser(prog="handoff", description="Render pages and list them with a prompt.")
    parser.add_argument("inputs", nargs="+", metavar="INPUT")
    parser.add_argument("--pages", default="")
    parser.add_argument("--dpi", type=int, default=0)
    g = parser.add_mutually_exclusive_group()
    g.add_argument("--vision-prompt")
    g.add_argument("--vision-prompt-file", type=Path)
    args = parser.parse_args(argv)
    prompt = _prompt(args)
    out = []
    for p in args.inputs:
        if not os.path.exists(p):
            parser.error(f"not found: {p}")
        if kind(p) == "unsupported":
            parser.error(f"unsupported file type: {p}")
        if kind(p) == "image" and args.pages:
            parser.error("--pages is for PDFs")
        spark = spark or session()
        if kind(p) == "image":
            rows = [(os.path.abspath(p), 1, os.path.abspath(p))]
        else:
            for need in ("text", "render"):
                requirements.require(requirements.pdf_requirement(need))
            files = _named(documents.files(spark, os.path.abspath(p)))
            signals = written(documents.signals(files), "signals")
            got = probe.probe_pdfs(_pages(files), signals.drop("pages"))
            if blocked := got.where("status = 'blocked'").select("reason").head():
                raise Failure(blocked.reason)
            wanted = got.select("path", pagesets.resolve_range(F.lit(args.pages), "pages", F.lit(0)).alias("pages")).join(signals.select("path", "width"), "path", "left")
            images = documents.rendered(files.join(wanted, "path").withColumn("dpi", F.lit(args.dpi) if args.dpi else auto_dpi("width", F.lit("pdf"))))
            folder, rows = tempfile.mkdtemp(prefix="handoff-"), []
            for r in images.toLocalIterator():  # a file a page, on the machine of whoever reads them
                if r.error:
                    raise Failure(f"{r.path}: {r.error}")
                name = os.path.join(folder, f"page-{r.n}.png")
                Path(name).write_bytes(bytes(r.content))
                rows.append((r.path, r.n, name))
        df = spark.createDataFrame(rows, "path string, n int, image string")
        out.append(render.manifest(df, F.lit(prompt if prompt.strip() else DEFAULT_PROMPT)).first().manifest)
        print(out[-1], file=sys.stderr)
    return out


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    commands = {"ocr": ocr, "frames": frames_command, "handoff": handoff}
    if not argv or argv[0] not in commands:
        print(f"usage: python -m pagewright.cli {{{','.join(commands)}}} ...", file=sys.stderr)
        return requirements.BAD_ARGUMENTS
    try:
        commands[argv[0]](argv[1:])
    except Failure as e:
        print(f"{argv[0]}: {e}", file=sys.stderr)
        return e.code
    except Exception as e:  # what failed inside an engine may hold a key or an address
        if argv[0] != "frames":
            raise
        print(f"frames: {'a file could not be read or written' if isinstance(e, OSError) else 'recognition failed'}", file=sys.stderr)
        return requirements.RUNTIME
    return requirements.OK


if __name__ == "__main__":
    sys.exit(main())
