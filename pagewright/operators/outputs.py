"""Files from documents: sets that are written whole or not at all, routing by format, newline-delimited records."""

from __future__ import annotations

import json
import os
import shutil
import unicodedata
import uuid
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from pagewright.functions.requirements import Failure

FORMATS = ("md", "txt", "json")


def _synced(path: Path, content: str) -> None:
    with path.open("w", encoding="utf-8") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())


def write_set(files: Mapping[str, str]) -> None:
    """Write all files, or leave every one as it was.

    New contents are staged beside their targets, old ones set aside; should any move fail, the moves made are undone.
    """
    mark = uuid.uuid4().hex
    targets = {Path(p): c for p, c in files.items()}
    beside = lambda p, kind: p.with_name(f".{p.name}.{mark}.{kind}")
    moved: list[tuple[Path, Path | None]] = []  # target, and where its old content is
    try:
        for p, content in targets.items():
            p.parent.mkdir(parents=True, exist_ok=True)
            _synced(beside(p, "new"), content)
        for p in targets:
            old = beside(p, "old") if p.exists() else None
            if old:
                os.replace(p, old)
            moved.append((p, old))
            os.replace(beside(p, "new"), p)
    except OSError as e:
        for p, old in reversed(moved):
            if old:
                os.replace(old, p)
            elif p.is_file():
                p.unlink()
        raise Failure(f"nothing was written: {e}") from e
    finally:
        for p in targets:
            beside(p, "new").unlink(missing_ok=True)
        for _, old in moved:
            if old:
                old.unlink(missing_ok=True)


def write_json(path: str | Path, document: Any) -> None:
    """One JSON file, replaced in a single step."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    staged = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        _synced(staged, json.dumps(document, ensure_ascii=False, indent=2) + "\n")
        os.replace(staged, path)
    finally:
        staged.unlink(missing_ok=True)


def write_records(df: DataFrame, path: str) -> None:
    """Newline-delimited JSON, a row a record, written by executors; nulls are left out."""
    df.write.mode("errorifexists").json(path)


def parse_list(value: str, known: Sequence[str], what: str, every: str | None = None) -> tuple[str, ...]:
    """A comma-separated choice among the known, each once, in the order first named; ``every`` stands for all."""
    out: dict[str, None] = {}
    for part in map(str.strip, value.split(",")):
        if part != every and part not in known:
            raise Failure(f"{what} {part!r} is none of {', '.join(known)}" if part else f"an empty {what} in {value!r}")
        out |= dict.fromkeys(known if part == every else [part])
    return tuple(out)


def same_stems(paths: Iterable[str]) -> list[str]:
    """Stems that two of the paths share, case and composition aside."""
    by: dict[str, list[str]] = {}
    for p in paths:
        by.setdefault(unicodedata.normalize("NFC", Path(p).stem).casefold(), []).append(Path(p).stem)
    return sorted({s for group in by.values() if len(group) > 1 for s in group})


def route(contents: Mapping[str, str], source: str, out: str, inputs: int = 1) -> dict[str, str]:
    """Contents by format to contents by path: a folder's <stem>.<format>, or the one path that was asked for."""
    if os.path.isdir(out) or len(contents) > 1 or inputs > 1:
        return {os.path.join(out, f"{Path(source).stem}.{fmt}"): c for fmt, c in contents.items()}
    return {out: next(iter(contents.values()))}


def searchable_pdf(source: str, out: str, lang: str) -> str | None:
    """Make a searchable PDF by the external program; what went wrong, if anything. That never stops a run."""
    import subprocess

    program = shutil.which("ocrmypdf")
    if program is None:
        return "ocrmypdf is not installed; no searchable PDF was made"
    done = subprocess.run([program, "-l", lang, "--rotate-pages", "--deskew", "--force-ocr", source, out], capture_output=True, text=True)
    return f"ocrmypdf failed with {done.returncode}" if done.returncode else None
