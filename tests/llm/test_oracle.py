"""Queries with SQL, side by side on the smallest tables; registry and independence of the rest."""

import os
import subprocess
import sys

import pytest

from gramlode.llm import registry

from ..oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, registry.queries()[name], registry.oracle_sql()[name]) == ""


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries() if k.startswith("op")) == list(range(1, 11))


def test_entry_without_these_folders(tmp_path):
    """A copy of the repository without the operators still has its other queries."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import shutil

    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(q) == sorted(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True)
    assert out.stdout.strip().endswith("True False"), out.stderr
