"""The library without the training-data parts: the entry imports, and nothing else needs them."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as E; q = E.queries(); assert 'e02_overall' in q and set(E.oracle_sql()) <= set(q); print(*sorted(q))"


@pytest.mark.parametrize("without", [("quarry/llm", "corpus_pipeline.py"), ("quarry/llm",)])
def test_entry_imports_without_the_training_data_parts(tmp_path, without):
    gone = {os.path.join(ROOT, w) for w in without}
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: [n for n in names if os.path.join(d, n) in gone or n in (".git", "__pycache__")])
    got = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path / "copy", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert got.returncode == 0, got.stderr
    assert "pipeline" not in got.stdout.split() and not any(q.startswith("op") for q in got.stdout.split())
