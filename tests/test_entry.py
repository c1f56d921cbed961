"""The entry module with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import re, __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(re.match(r'op\\d+_|pipeline$', n) for n in q))"


def asked(folder):
    return subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


@pytest.fixture()
def copy(tmp_path):
    shutil.copytree(f"{ROOT}/passagework", tmp_path / "passagework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    return tmp_path


def test_the_rest_stands_alone(copy):
    got = asked(copy)
    assert got.returncode == 0, got.stderr
    n, any_llm = got.stdout.split()
    assert int(n) > 90 and any_llm == "False"


def test_a_broken_subpackage_is_an_error(copy):
    (copy / "passagework" / "llm").mkdir()
    (copy / "passagework" / "llm" / "__init__.py").write_text("")
    (copy / "passagework" / "llm" / "queries.py").write_text("from . import missing_module\n")
    assert asked(copy).returncode != 0
    (copy / "passagework" / "llm" / "queries.py").write_text("import passagework.llm.gone\n")
    got = asked(copy)
    assert got.returncode != 0 and "gone" in got.stderr
