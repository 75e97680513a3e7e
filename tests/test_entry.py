"""The driver's contract, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_flagship_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("left_out", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_the_rest_stands_without_the_llm_folders(tmp_path, left_out):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *left_out))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lab_trend' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin"}, check=True, timeout=120)
