"""The driver's entry module with and without the training-data files."""

import os
import shutil
import subprocess
import sys

from kpiloom.catalog.queries import QUERIES

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def _copy(target, without):
    shutil.copytree(f"{REPO}/kpiloom", f"{target}/kpiloom", ignore=shutil.ignore_patterns("__pycache__", *without))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and os.path.exists(f"{REPO}/{name}"):
            shutil.copy(f"{REPO}/{name}", target)


def _counts(folder):
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, check=True)
    return tuple(map(int, out.stdout.split()))


def test_core_queries_without_the_pipeline_or_the_subpackage(tmp_path):
    for i, without in enumerate((("corpus_pipeline.py",), ("llm",), ("corpus_pipeline.py", "llm"))):
        folder = tmp_path / str(i)
        folder.mkdir()
        _copy(folder, without)
        n, _ = _counts(folder)
        assert n == len(QUERIES)
