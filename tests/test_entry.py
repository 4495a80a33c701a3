"""The entry works without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_without_the_optional_part(tmp_path):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json"))
    found = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"],
        cwd=tree, capture_output=True, text=True, timeout=120)
    count, pipeline = found.stdout.split()
    assert int(count) > 100 and pipeline == "False", found.stderr
