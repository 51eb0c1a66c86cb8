"""Image preprocessing before recognition, a page at a time in Arrow batches. It needs an imaging package; without
one, images pass as they are, and a level that can't be had falls back to the one below."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Str, _c

LEVELS = ("none", "basic", "enhanced", "full")
NARROW, CONTRAST, DENOISE, LEAST_ANGLE, LEAST_POINTS, INK = 1400, 1.5, 10, 0.5, 100, 50


def basic(content: bytes) -> bytes:
    """Doubled if narrow, grey, contrast raised, sharpened."""
    from PIL import Image, ImageEnhance, ImageFilter

    image = Image.open(io.BytesIO(content)).convert("RGB")
    if image.width < NARROW:
        image = image.resize((image.width * 2, image.height * 2), Image.LANCZOS)
    out = io.BytesIO()
    ImageEnhance.Contrast(image.convert("L")).enhance(CONTRAST).filter(ImageFilter.SHARPEN).save(out, "PNG")
    return out.getvalue()


def enhanced(content: bytes, straighten: bool) -> bytes:
    """Doubled if narrow, grey, denoised, for level full set straight, and made black and white by neighbourhood."""
    import cv2
    import numpy as np

    image = cv2.imdecode(np.frombuffer(content, np.uint8), cv2.IMREAD_GRAYSCALE)
    if image.shape[1] < NARROW:
        image = cv2.resize(image, None, fx=2, fy=2, interpolation=cv2.INTER_LANCZOS4)
    image = cv2.fastNlMeansDenoising(image, None, DENOISE, 7, 21)
    points = np.column_stack(np.where(255 - image > INK))
    if straighten and len(points) >= LEAST_POINTS:
        angle = cv2.minAreaRect(points.astype(np.float32))[-1]
        angle = -(90 + angle) if angle < -45 else -angle
        if abs(angle) >= LEAST_ANGLE:
            h, w = image.shape
            turn = cv2.getRotationMatrix2D((w // 2, h // 2), angle, 1.0)
            image = cv2.warpAffine(image, turn, (w, h), flags=cv2.INTER_CUBIC, borderMode=cv2.BORDER_REPLICATE)
    image = cv2.adaptiveThreshold(image, 255, cv2.ADAPTIVE_THRESH_GAUSSIAN_C, cv2.THRESH_BINARY, 31, 10)
    return cv2.imencode(".png", image)[1].tobytes()


def prepared(content: bytes, level: str) -> bytes:
    steps = {"full": [lambda c: enhanced(c, True), basic], "enhanced": [lambda c: enhanced(c, False), basic], "basic": [basic]}.get(level, [])
    for step in steps:
        try:
            return step(content)
        except Exception:  # no package, or an image that it can't read
            continue
    return content


def preprocess(content: Str, level: Str) -> Column:
    """The image at a level; null stays null."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, levels in batches:
            yield pd.Series([None if c is None else prepared(bytes(c), v) for c, v in zip(contents, levels)], dtype=object)

    return run(_c(content), _c(level))
