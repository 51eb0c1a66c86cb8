"""Payloads of video frames: read, checked, one row a frame."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pagewright.functions.requirements import Failure

TIMES = ("timestamp", "timestampSeconds", "timeSeconds", "ptsSeconds")
FRAME = "index int, path string, bytes bigint, " + ", ".join(f"{t} string" for t in TIMES)


def parse_payload(raw: str) -> dict[str, Any]:
    """The JSON object of a payload; anything else is a failure."""
    if not raw.strip():
        raise Failure("no payload was given")
    try:
        payload = json.loads(raw)
    except ValueError as e:
        raise Failure(f"the payload is not JSON: {e}") from e
    if not isinstance(payload, dict):
        raise Failure("the payload is not a JSON object")
    return payload


def check_payload(payload: dict[str, Any]) -> list[dict[str, Any]]:
    """The frames of a payload that is in order: folder, strategy, objects and readable files."""
    folder, frames = payload.get("outputDir"), payload.get("frames")
    wrong = [
        (not isinstance(folder, str) or not os.path.isabs(folder), "outputDir must be an absolute path"),
        (isinstance(folder, str) and not os.path.isdir(folder), "outputDir is no folder"),
        (payload.get("strategy") not in ("scene", "fps"), "strategy must be scene or fps"),
        *((not isinstance(payload.get(k), dict), f"{k} must be an object") for k in ("video", "extraction")),
        (not isinstance(frames, list) or not frames, "frames must list at least one frame"),
    ]
    for bad, why in wrong:
        if bad:
            raise Failure(why)
    for i, frame in enumerate(frames):
        path = frame.get("path") if isinstance(frame, dict) else None
        if not isinstance(path, str) or not path:
            raise Failure(f"frame {i} must be an object with a path")
        if not (os.path.isfile(path) and os.access(path, os.R_OK)):
            raise Failure(f"frame {i} can't be read: {path}")
    return frames


def frame_rows(spark: SparkSession, frames: list[dict[str, Any]]) -> DataFrame:
    """A row a frame: index, path, bytes and the times it was given with, as JSON."""
    rows = [(i, f["path"], int(f.get("bytes", os.path.getsize(f["path"]))), *(json.dumps(f[t]) if t in f else None for t in TIMES)) for i, f in enumerate(frames)]
    return spark.createDataFrame(rows, FRAME)
