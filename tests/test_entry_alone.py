"""The entry point without the training-data package: it still imports, and has all other queries."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sorted(n for n in q if n == 'pipeline' or n[:2] == 'op' and n[2:3].isdigit()))"


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_without_the_package(tmp_path, left_out):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *left_out))
    assert not (copy / "datagauge" / "llm").exists() and not (copy / "tests" / "llm").exists()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    n, names = done.stdout.split(" ", 1)
    assert int(n) > 150 and names.strip() == "[]"


def test_nothing_else_imports_the_package():
    for folder in ("datagauge", "checks", "tests"):
        for top, dirs, files in os.walk(os.path.join(REPO, folder)):
            dirs[:] = [d for d in dirs if d != "llm"]
            for name in files:
                if name.endswith(".py") and name != os.path.basename(__file__):
                    with open(os.path.join(top, name), encoding="utf-8") as file:
                        text = file.read()
                    assert "datagauge.llm" not in text and "corpus_pipeline" not in text and "from .llm" not in text, name
