"""Frames of a video to one document: recognised in one Spark job, assembled in frame order, written in one step."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import __version__
from pagewright.functions import engines
from pagewright.functions.requirements import Failure
from pagewright.operators import render
from pagewright.operators.outputs import write_json
from pagewright.sources.frames import TIMES, check_payload, frame_rows

from .recognize import COLUMNS, Options, recognize_images


def frame_results(spark: SparkSession, frames: DataFrame, options: Options) -> DataFrame:
    """index, path, bytes, times, pages (JSON), text, markdown of frame rows."""
    names = frames.select("path").distinct()
    content = spark.read.format("binaryFile").load([r.path for r in names.collect()]).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    pages = recognize_images(content, options)
    texts, marks = render.to_text(pages), render.to_markdown(pages, markdown="markdown")
    rows = pages.groupBy("path").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col("n").alias("_o"), F.struct("n", *[c for c in COLUMNS if c not in ("path", "n")]).alias("p")))), lambda x: x["p"])).alias("pages"))
    return frames.join(rows, "path").join(texts, "path").join(marks, "path")


def process_payload(spark: SparkSession, payload: dict[str, Any], options: Options, output: str | None = None) -> tuple[dict[str, Any], Path]:
    """The document and where it goes. Prompts, keys and addresses of services are not in it."""
    frames = check_payload(payload)
    engines.engine(options.engine)
    got = frame_results(spark, frame_rows(spark, frames), options).orderBy("index").collect()  # one document: bounded by the payload
    if len(got) != len(frames):
        raise Failure("some frames gave no pages")
    results = []
    for r in got:
        times = {t: json.loads(r[t]) for t in TIMES if r[t] is not None}
        results.append({"index": r["index"], "path": r.path, "bytes": r.bytes, "pages": json.loads(r.pages), "text": r.text, "markdown": r.markdown} | times)
    document = {
        "schemaVersion": 1,
        "packageVersion": __version__,
        "source": "frames",
        "outputDir": payload["outputDir"],
        "strategy": payload["strategy"],
        "engine": options.engine,
        "lang": options.lang,
        "frames": results,
        "text": "\n\n".join(r["text"] for r in results),
        "markdown": "\n\n".join(f"## Frame {r['index'] + 1}\n\n{r['markdown']}" for r in results),
    }
    return document, Path(output or os.path.join(payload["outputDir"], "ocr.json"))


def sink(spark: SparkSession, payload: dict[str, Any], options: Options, output: str | None = None) -> Path:
    document, path = process_payload(spark, payload, options, output)
    write_json(path, document)
    return path
