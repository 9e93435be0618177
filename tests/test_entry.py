"""The driver's entry file with and without the corpus operators."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(sum(q.startswith('op') for q in e.queries()), 'pipeline' in e.queries(), 'v5_keep_first' in e.queries())"


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_entry_imports_without_the_corpus_operators(tmp_path, pipeline):
    absent = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=absent)
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path / "repo", capture_output=True, text=True, check=True)
    assert done.stdout.split() == ["0", "False", "True"]
