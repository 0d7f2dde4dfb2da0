"""The driver's entry: queries and SQL by the same names, and imports that hold without the corpus subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert entry.entry(spark).columns == ["name", "w", "cur", "prev"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_needs_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT / "fathomline", tmp_path / "fathomline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
    for p in (ROOT / "fathomline").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
