"""What engines need: a table of components, probed on the driver and on executors; errors and exit codes.

Probing looks for programs and module specs only: nothing is imported, started or downloaded.
"""

from __future__ import annotations

import ipaddress
import shutil
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from importlib.util import find_spec
from typing import Any
from urllib.parse import urlsplit

OK, BAD_ARGUMENTS, UNSUPPORTED, MISSING, RUNTIME = 0, 2, 3, 4, 5


class Failure(Exception):
    """What stops a run, with the exit code of a command that meets it."""

    def __init__(self, message: str, code: int = BAD_ARGUMENTS):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Requirement:
    """The first unmet need of an engine, or code ``ok``. Of ``components``, all or any is needed."""

    engine: str
    code: str = "ok"
    kind: str | None = None  # binary, package, runtime, configuration, engine
    components: tuple[str, ...] = ()
    relation: str = "all"
    extra: str | None = None
    note: str | None = None

    @property
    def available(self) -> bool:
        return self.code == "ok"

    def record(self) -> dict[str, Any]:
        return asdict(self) | {"available": self.available, "component": self.components[0] if self.components else None}


class Unmet(Failure):
    """A requirement that is not met."""

    def __init__(self, requirement: Requirement):
        r = self.requirement = requirement
        what = (" or " if r.relation == "any" else " and ").join(r.components)
        said = {"engine": f"no such engine: {what}", "configuration": f"{r.engine} must be given {what}"}.get(r.kind or "", f"{r.engine} needs {what}, not found here")
        super().__init__(said + (f"; {r.note}" if r.note else ""), BAD_ARGUMENTS if r.kind in ("configuration", "engine") else MISSING)


PROGRAMS = ("tesseract", "pdftoppm", "pdftotext", "pdfinfo", "pdffonts", "pdfimages", "ocrmypdf")
MODULES = {"pytesseract": "pytesseract", "fitz": "fitz", "opencv": "cv2", "numpy": "numpy", "easyocr": "easyocr", "openai": "openai", "pillow": "PIL", "paddleocr": "paddleocr", "paddle": "paddle"}
PARSER_MODULES = ("paddlex", "tokenizers", "einops")


def _has_module(name: str) -> bool:
    try:
        return find_spec(name) is not None
    except (ImportError, ValueError):
        return False


def capabilities() -> dict[str, str | bool]:
    """Programs by path, modules and the document parser by presence, as this process finds them."""
    found: dict[str, str | bool] = {f"bin_{p}": shutil.which(p) or "" for p in PROGRAMS}
    found |= {f"has_{k}": _has_module(m) for k, m in MODULES.items()}
    return found | {"has_doc_parser": all(map(_has_module, PARSER_MODULES))}


def cluster_capabilities(spark, tasks: int | None = None):
    """A row for each name and how many of ``tasks`` probes on executors found it."""
    import pandas as pd
    from pyspark.sql import functions as F

    n = tasks or spark.sparkContext.defaultParallelism

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                got = capabilities()
                yield pd.DataFrame({"name": list(got), "found": [bool(v) for v in got.values()]})

    seen = spark.range(0, n, 1, n).mapInPandas(probe, "name string, found boolean")
    return seen.groupBy("name").agg(F.count_if("found").alias("found"), F.count("*").alias("probed"))


def _lookup(caps: Any) -> Callable[[str], bool]:
    """Capabilities by name: given ones, as a mapping or attributes, win; the rest are probed when asked for."""
    own: dict[str, Any] = {}

    def has(name: str) -> bool:
        given = caps.get(name) if isinstance(caps, Mapping) else getattr(caps, name, None)
        if given is None:
            if not own:
                own.update(capabilities())
            given = own[name]
        return bool(given)

    return has


def is_loopback(url: str) -> bool:
    """Whether an http or https URL names this machine."""
    try:
        parts = urlsplit(url.strip())
        name = (parts.hostname or "").casefold()
        return parts.scheme in ("http", "https") and (name == "localhost" or bool(name) and ipaddress.ip_address(name).is_loopback)
    except ValueError:
        return False


_WEIGHTS = "the first run may download model weights"


def engine_requirement(engine: str, settings: Mapping[str, str] | None = None, caps: Any = None) -> Requirement:
    """The first unmet need of an engine under its settings."""
    has, given = _lookup(caps), {k: (v or "").strip() for k, v in (settings or {}).items()}
    missing = [c for c in ("paddleocr", "paddle") if engine.startswith("paddleocr") and not has(f"has_{c}")]
    only_runtime = missing == ["paddle"]
    url = given.get("paddle_vl_server_url", "")
    needs: dict[str, list[tuple[bool, str, str, tuple[str, ...]]]] = {
        "tesseract": [(engine == "tesseract" and not has("bin_tesseract"), "missing_tesseract_binary", "binary", ("tesseract",))],
        "easyocr": [(engine == "easyocr" and not has("has_easyocr"), "missing_easyocr_package", "package", ("easyocr",))],
        "paddleocr": [(bool(missing), "missing_paddle_runtime" if only_runtime else "missing_paddleocr_package", "runtime" if only_runtime else "package", tuple(missing))],
        "paddleocr-vl-mlx": [
            (bool(missing), "missing_paddle_runtime" if only_runtime else "missing_paddleocr_doc_parser", "runtime" if only_runtime else "package", tuple(missing)),
            (engine == "paddleocr-vl-mlx" and not has("has_doc_parser"), "missing_paddleocr_doc_parser", "package", ("paddleocr[doc-parser]",)),
            (not url, "missing_paddle_vl_server_url", "configuration", ("paddle_vl_server_url",)),
            (not is_loopback(url), "unsafe_paddle_vl_server_url", "configuration", ("paddle_vl_server_url",)),
            (not given.get("paddle_vl_model"), "missing_paddle_vl_model", "configuration", ("paddle_vl_model",)),
        ],
        "vision": [
            (engine == "vision" and not has("has_openai"), "missing_openai_package", "package", ("openai",)),
            (not given.get("vision_api_key"), "missing_vision_api_key", "configuration", ("vision_api_key",)),
            (not given.get("vision_model"), "missing_vision_model", "configuration", ("vision_model",)),
        ],
    }
    extra, note = {"easyocr": ("easyocr", _WEIGHTS), "paddleocr": ("paddle", _WEIGHTS), "paddleocr-vl-mlx": ("paddle-vl", _WEIGHTS), "vision": ("vision", None)}.get(engine, (None, None))
    if engine not in needs:
        return Requirement(engine, "unsupported_engine", "engine", (engine,))
    for unmet, code, kind, components in needs[engine]:
        if unmet:
            return Requirement(engine, code, kind, components, "all", extra, note)
    return Requirement(engine, note=note)


def pdf_requirement(need: str | None = None, caps: Any = None) -> Requirement:
    """What PDFs need: to ``render`` or to read ``text`` (None: both, rendering first). A program or a module will do."""
    has = _lookup(caps)
    for what, program in (("render", "pdftoppm"), ("text", "pdftotext")):
        if need in (None, what) and not has("has_fitz") and not has(f"bin_{program}"):
            return Requirement("pdf", f"missing_pdf_{what}_backend", "binary", (program, "pymupdf"), "any", "pdf")
    return Requirement("pdf")


def require(requirement: Requirement) -> None:
    if not requirement.available:
        raise Unmet(requirement)


@contextmanager
def importing(engine: str, extra: str | None = None):
    """Turns a failed import of an engine's package, or of what that needs, into an unmet requirement."""
    try:
        yield
    except (ImportError, OSError) as e:
        root = (getattr(e, "name", None) or engine).split(".")[0]
        code = f"missing_{engine}_package" if root == engine else f"missing_{engine}_dependency"
        raise Unmet(Requirement(engine, code, "package", ("pillow" if root == "PIL" else root,), "all", extra)) from e


def vision_settings(key: str = "", model: str = "", url: str = "") -> tuple[str, str, str | None]:
    """Trimmed settings of the vision service; the environment is not read. A key and a model must be given."""
    key, model = (key or "").strip(), (model or "").strip()
    for value, name in ((key, "vision_api_key"), (model, "vision_model")):
        if not value:
            raise Unmet(Requirement("vision", f"missing_{name}", "configuration", (name,)))
    return key, model, (url or "").strip() or None
