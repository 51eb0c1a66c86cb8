"""The entry points, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as registered

ROOT = Path(registered.__file__).resolve().parent


def test_every_sql_belongs_to_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_flagship_query(spark):
    df = registered.entry(spark)
    assert df.count() > 0 and "needs_ocr" in df.columns


def test_the_rest_works_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "pagewright", tmp_path / "pagewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'probe_decision' in q and set(e.oracle_sql()) <= set(q); assert not any(x.startswith('op') or x == 'pipeline' for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
