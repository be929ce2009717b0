"""The library without the training-data operators: a copy of the tree with their folders taken out still imports."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False], ids=["pipeline file left", "pipeline file gone"])
def test_imports_without_the_folders(tmp_path, pipeline):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=lambda d, names: {n for n in names if n in (".git", "llm", "__pycache__", ".pytest_cache") or (n == "corpus_pipeline.py" and not pipeline)})
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tree, env=env, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    n, has_pipeline, has_op, sql_named = ran.stdout.split()
    assert int(n) > 150 and (has_pipeline, has_op, sql_named) == ("False", "False", "True")
