"""The entry without the subpackage llm, and with it."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(where: Path) -> set[str]:
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"], cwd=where, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(where)})
    assert said.returncode == 0, said.stderr
    return set(said.stdout.split())


def test_without_llm(tmp_path):
    """Whether corpus_pipeline.py stays or goes, the rest is whole when the folder llm is away."""
    shutil.copytree(ROOT / "quillmill", tmp_path / "quillmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    left = names(tmp_path)
    assert left and "pipeline" not in left and not any(n.startswith("op") and n[2:3].isdigit() for n in left)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(tmp_path) == left
    assert left <= names(ROOT)
