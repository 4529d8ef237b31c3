"""The entry module with and without the optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "cached code"])
def test_entry_without_the_subpackage(tmp_path, left):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "quadlake", tmp_path / "quadlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if left != "nothing":
        (tmp_path / "quadlake" / "llm").mkdir()
    if left == "cached code":
        (tmp_path / "quadlake" / "llm" / "__pycache__").mkdir()
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    names = said.stdout.split()
    assert "pattern_s" in names and "p5_found" in names and not any(n.startswith(("p7", "p9")) for n in names)
