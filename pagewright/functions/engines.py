"""Recognition engines: functions from batches of page images to batches of results, run by mapInPandas.

An engine takes an iterator of frames with (path, n, content, text, lang) and yields frames with (path, n, text,
markdown, mean_conf, words, error) and, if it likes, elapsed_s. A failure is a row with an error, not an exception: a retried task must not repeat paid
calls, and the workflow decides whether to stop. Engines are looked up by name on the executors, so a worker loads a
model once.

Local recognisers, rasterisers and vision services are adapters around programs that this environment lacks; their
output parsers are in ``operators.geometry`` and are tested, the programs themselves are not.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .codes import PADDLE_LANG
from .requirements import engine_requirement, importing, require, vision_settings
from .text import DEFAULT_PROMPT

RESULT = "path string, n int, text string, markdown string, mean_conf double, words array<struct<text:string,conf:int,bbox:array<int>>>, error string, elapsed_s double"
Run = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


@dataclass(frozen=True)
class Engine:
    name: str
    run: Run
    structured: bool = False


_ENGINES: dict[str, Engine] = {}


def register_engine(name: str, run: Run, structured: bool = False) -> None:
    """Make an engine known by name. One that needs settings (vision, paddleocr-vl-mlx) is registered with them."""
    _ENGINES[name] = Engine(name, run, structured)


def engine(name: str) -> Engine:
    if name not in _ENGINES:
        raise KeyError(f"unknown engine {name!r}; known: {', '.join(sorted(_ENGINES))}")
    return _ENGINES[name]


#: Bytes, about, of text and content that an engine is given at once, or one page of more: words take some hundred times
#: as much as Python objects, and a batch of Spark's has 10,000 pages of any length.
PIECE_BYTES = 1 << 18


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of batches, in order, in frames of at most PIECE_BYTES of text and content or of one row."""
    for b in batches:
        sizes = [sum(len(x) for x in row if isinstance(x, (str, bytes))) for row in zip(*(b[c] for c in ("text", "content") if c in b))]
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if i > begin and held + size > PIECE_BYTES:
                yield b.iloc[begin:i].reset_index(drop=True)
                begin, held = i, 0
            held += size
        if begin < len(b):
            yield b.iloc[begin:].reset_index(drop=True)


def apply(pages: DataFrame, name: str) -> DataFrame:
    """Results of an engine on pages (path, n, content or text, and lang where it is known)."""
    run = engine(name).run

    def timed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in run(pieces(batches)):
            yield b if "elapsed_s" in b else b.assign(elapsed_s=None)

    return pages.mapInPandas(timed, RESULT)


def _stub(shift: int) -> Run:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].fillna("")
            words = [[{"text": w, "conf": (31 * i + 7 * int(n)) % 60 + shift, "bbox": [40 * (i % 11), 12 * (i // 11), 30, 10]} for i, w in enumerate(t.split())] for t, n in zip(texts, b["n"])]
            conf = [sum(w["conf"] for w in ws) / len(ws) if ws else 0.0 for ws in words]
            yield pd.DataFrame({"path": b["path"], "n": b["n"], "text": texts, "markdown": None, "mean_conf": conf, "words": words, "error": None})

    return run


def _row(path: str, n: int, **more) -> dict:
    return {"path": path, "n": n, "text": "", "markdown": None, "mean_conf": None, "words": [], "error": None, "elapsed_s": None} | more


def _adapter(page: Callable[[object, str, int, bytes], dict], load: Callable[[str], object], of: Callable[[str], str] = lambda lang: "") -> Run:
    """An engine from a function of one page; its model is loaded once a worker, and for each language that ``of`` tells
    apart, when the first page comes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict = {}
        for b in batches:
            rows = []
            for path, n, content, lang in zip(b["path"], b["n"], b["content"], _langs(b)):
                try:
                    if (key := of(lang)) not in models:
                        models[key] = load(key)
                    rows.append(_row(path, n, **page(models[key], path, int(n), content)))
                except Exception as e:  # a row: a retried task would repeat paid calls, and messages may hold secrets
                    rows.append(_row(path, n, error=f"{type(e).__name__} on page {n}"))
            if rows:
                yield pd.DataFrame(rows)

    return run


def _langs(b: pd.DataFrame, default: str = "") -> list[str]:
    """The language of each page: its own, where the workflow has found one."""
    return [x or default for x in b["lang"]] if "lang" in b else [default] * len(b)


def _image_file(content: bytes):
    f = tempfile.NamedTemporaryFile(suffix=".png")
    f.write(content)
    f.flush()
    return f


def line_result(texts: list[str], scores: list[float], polys: list) -> dict:
    """A page from a line recogniser's arrays: blanks dropped, reading order; a missing score is 0."""
    rows = []
    for i, t in enumerate(texts):
        if t.strip():
            score = float(scores[i]) if i < len(scores) else 0.0
            xs, ys = ([int(p[k]) for p in polys[i]] for k in (0, 1)) if i < len(polys) else ([0], [0])
            rows.append((min(ys), min(xs), i, score, {"text": t, "conf": int(score * 100), "bbox": [min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)]}))
    rows.sort(key=lambda r: r[:3])
    words = [r[4] for r in rows]
    return {"text": "\n".join(w["text"] for w in words), "words": words, "mean_conf": 100 * sum(r[3] for r in rows) / len(rows) if rows else 0.0}


def easyocr() -> Run:
    """Russian and English lines on the CPU, whatever the language asked for."""

    def load(_):
        with importing("easyocr", "easyocr"):
            import easyocr as package
        return package.Reader(["ru", "en"], gpu=False)

    def page(model, path, n, content):
        got = model.readtext(content)
        words = [{"text": t, "conf": int(c * 100), "bbox": line_result([t], [c], [p])["words"][0]["bbox"] if t.strip() else [0] * 4} for p, t, c in got]
        return {"text": "\n".join(w["text"] for w in words), "words": words, "mean_conf": sum(w["conf"] for w in words) / len(words) if words else 0.0}

    return _adapter(page, load)


def line_lang(lang: str) -> str:
    """codes.paddle_lang of one value."""
    return PADDLE_LANG.get((lang or "").split("+")[0].strip().lower(), "en")


def paddleocr() -> Run:
    """Lines in the language of each page, as the line recogniser calls it."""

    def load(lang: str):
        with importing("paddleocr", "paddle"):
            import paddleocr as package
        return package.PaddleOCR(lang=lang, use_doc_orientation_classify=False, use_doc_unwarping=False)

    def page(model, path, n, content):
        with _image_file(content) as f:
            texts, scores, polys = [], [], []
            for r in model.predict(f.name):
                texts += r.get("rec_texts") or []
                scores += r.get("rec_scores") or []
                polys += list(r["rec_polys"] if r.get("rec_polys") is not None else r.get("dt_polys") or [])
        return line_result(texts, scores, polys)

    return _adapter(page, load, line_lang)


def _markdown_of(results) -> str:
    """Markdown of a document parser's results: parts by lines, blanks dropped, paragraphs between."""
    out = []
    for r in results:
        m = getattr(r, "markdown", None) or (r.get("markdown") if isinstance(r, dict) else None) or {}
        t = m.get("markdown_texts", "") if isinstance(m, dict) else ""
        out.append(("\n".join(t) if isinstance(t, (list, tuple)) else str(t)).strip())
    return "\n\n".join(t for t in out if t)


def paddleocr_vl(server_url: str, model: str) -> Run:
    """Markdown by a document parser whose language model is served on this machine; asked again once if empty."""
    require(engine_requirement("paddleocr-vl-mlx", {"paddle_vl_server_url": server_url, "paddle_vl_model": model}))

    def load(_):
        with importing("paddleocr", "paddle-vl"):
            import paddleocr as package
        return package.PaddleOCRVL(vl_rec_backend="mlx-vlm-server", vl_rec_server_url=server_url.rstrip("/") + "/", vl_rec_max_concurrency=1, vl_rec_api_model_name=model, markdown_ignore_labels=[])

    def page(parser, path, n, content):
        with _image_file(content) as f:
            got = next((m for m in (_markdown_of(parser.predict(f.name, temperature=0)) for _ in range(2)) if m), "")
        return {"markdown": got, "text": got} if got else {"error": f"nothing was recognised on page {n}"}

    return _adapter(page, load)


IMAGE_BYTES, JPEG_QUALITY, SHRINK, MAX_TOKENS = 7_500_000, 92, 0.85, 4096


def fitted(content: bytes, limit: int = IMAGE_BYTES) -> tuple[bytes, str]:
    """An image within the limit and its media type: as it is, or as JPEG, made smaller step by step until it fits."""
    if len(content) <= limit:
        webp = content[:4] == b"RIFF" and content[8:12] == b"WEBP"
        return content, "image/jpeg" if content[:3] == b"\xff\xd8\xff" else "image/webp" if webp else "image/png"
    import io

    with importing("vision", "vision"):
        from PIL import Image
    image = Image.open(io.BytesIO(content)).convert("RGB")
    scale, size = 1.0, image.size
    while True:
        out = io.BytesIO()
        (image if size == image.size else image.resize(size, Image.LANCZOS)).save(out, "JPEG", quality=JPEG_QUALITY, subsampling=0)
        if out.tell() <= limit or min(size) <= 1:
            return out.getvalue(), "image/jpeg"
        scale *= SHRINK
        size = tuple(max(1, int(x * scale)) for x in image.size)


def vision(key: str, model: str, url: str = "", prompt: str = "", timeout: float | None = None) -> Run:
    """Markdown by a chat service that reads images. The prompt is the caller's, unchanged, unless blank."""
    import base64

    key, model, endpoint = vision_settings(key, model, url)
    text = prompt if prompt.strip() else DEFAULT_PROMPT

    def load(_):
        with importing("openai", "vision"):
            import openai as package
        return package.OpenAI(api_key=key, base_url=endpoint, **({} if timeout is None else {"timeout": timeout}))

    def page(client, path, n, content):
        body, kind = fitted(content)
        image = {"url": f"data:{kind};base64,{base64.b64encode(body).decode()}", "detail": "high"}
        asked = [{"type": "image_url", "image_url": image}, {"type": "text", "text": text}]
        said = client.chat.completions.create(model=model, max_tokens=MAX_TOKENS, messages=[{"role": "user", "content": asked}])
        got = said.choices[0].message.content or ""
        return {"markdown": got, "text": got} if got.strip() else {"error": f"nothing was recognised on page {n}"}

    return _adapter(page, load)


def whole_documents(pages: DataFrame) -> DataFrame:
    """A page 0 a file from a vision service's pages: its Markdown, a heading a page, in order."""
    from pyspark.sql import functions as F

    part = F.struct("n", F.concat(F.lit("## Page "), F.col("n"), F.lit("\n\n"), F.col("markdown")).alias("m"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["m"]), "\n\n")
    return pages.groupBy("path").agg(joined.alias("markdown")).select("path", F.lit(0).alias("n"), F.col("markdown").alias("text"), "markdown")


register_engine("easyocr", easyocr())
register_engine("paddleocr", paddleocr())
register_engine("stub", _stub(25))
register_engine("stub-clean", _stub(40))


def _retry_wins(first: list[dict], again: list[dict], mean: Callable[[list[dict]], float]) -> bool:
    """geometry.better_retry of one page."""
    return len(again) > len(first) or (bool(again) and mean(again) > mean(first) + 5)


def _mean(words: list[dict]) -> float:
    return sum(w["conf"] for w in words) / len(words) if words else 0.0


def package_page(package, name: str, lang: str, psm: int) -> dict:
    """A page by the recogniser's package. What was read as English alone is read again as Russian and English, and
    that is taken if it is better: a page of few words may hide its script."""
    config = f"--oem 3 --psm {psm}"

    def read(lang: str) -> list[dict]:
        got = package.image_to_data(name, lang=lang, config=config, output_type=package.Output.DICT)
        boxes = zip(got["left"], got["top"], got["width"], got["height"])
        return [{"text": t, "conf": int(c), "bbox": list(box)} for t, c, box in zip(got["text"], got["conf"], boxes) if int(c) != -1 and t.strip()]

    words = read(lang)
    if lang == "eng" and _retry_wins(words, again := read("rus+eng"), _mean):
        words, lang = again, "rus+eng"
    return {"text": package.image_to_string(name, lang=lang, config=config), "words": words, "mean_conf": _mean(words)}


def program_page(program: str, name: str, lang: str, psm: int) -> dict:
    """A page by the command-line recogniser: text, and words from its table."""
    call = [program, name, "stdout", "-l", lang, "--oem", "3", "--psm", str(psm)]
    table = subprocess.run([*call, "tsv"], capture_output=True, text=True)
    plain = subprocess.run(call, capture_output=True, text=True)
    if plain.returncode:
        return {"error": f"{os.path.basename(program)} failed with {plain.returncode}"}
    words = parse_tsv(table.stdout) if not table.returncode else []
    return {"text": plain.stdout, "words": [w | {"conf": int(w["conf"])} for w in words], "mean_conf": _mean(words)}


def _recogniser():
    """The recogniser's package, or None where it is missing or broken: then its program is called."""
    try:
        import pytesseract

        return pytesseract
    except (ImportError, OSError):
        return None


def tesseract(lang: str = "eng", psm: int = 3, binary: str = "tesseract") -> Run:
    """Pages in their own language, or in ``lang``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program, package = shutil.which(binary), _recogniser()
        for b in batches:
            rows = []
            for path, n, content, own in zip(b["path"], b["n"], b["content"], _langs(b, lang)):
                began = time.monotonic()
                if program is None:
                    made = {"error": f"{binary} is not installed"}
                else:
                    with _image_file(content) as f:
                        made = package_page(package, f.name, own, psm) if package else program_page(program, f.name, own, psm)
                    made["elapsed_s"] = round(time.monotonic() - began, 2)
                rows.append(_row(path, n, **({"mean_conf": 0.0} | made)))
            yield pd.DataFrame(rows)

    return run


def script_reports(images: DataFrame, binary: str = "tesseract", seconds: int = 30) -> DataFrame:
    """path, report: what orientation and script detection prints of images (path, content); empty where it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program = shutil.which(binary)
        for b in batches:
            said = []
            for content in b["content"]:
                try:
                    with _image_file(content) as f:
                        done = subprocess.run([program, f.name, "stdout", "--psm", "0", "-l", "osd"], capture_output=True, text=True, timeout=seconds) if program else None
                    said.append(done.stdout + "\n" + done.stderr if done else "")
                except (OSError, subprocess.SubprocessError):
                    said.append("")
            yield pd.DataFrame({"path": b["path"], "report": said})

    return images.select("path", "content").mapInPandas(run, "path string, report string")


def parse_tsv(table: str) -> list[dict]:
    out = []
    for line in table.splitlines()[1:]:
        cells = line.split("\t")
        if len(cells) < 12 or not cells[11].strip():
            continue
        try:
            conf = float(cells[10])
        except ValueError:
            continue
        if conf != -1:
            box = cells[6:10]
            out.append({"text": cells[11].strip(), "conf": conf, "bbox": [int(x) for x in box] if all(x.strip().lstrip("-").isdigit() for x in box) else [0] * 4})
    return out


register_engine("tesseract", tesseract())
