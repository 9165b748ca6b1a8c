"""The entry points without the corpus operators and their pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [["tierscore/llm"], ["tierscore/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_import_without_corpus_folders(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    done = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert "cascade_decisions" in done.stdout and "'pipeline'" not in done.stdout
    if "tierscore/llm" in gone:
        assert "'op1_" not in done.stdout
