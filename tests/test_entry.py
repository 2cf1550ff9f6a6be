"""The driver's entry, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


@pytest.fixture
def core(tmp_path):
    """A copy of the repository without the subpackage, its tests and its pipeline."""
    for name in ("sievelake", "tests"):
        shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(REPO / name, tmp_path / name)
    return tmp_path


def python(folder, *args):
    env = os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, *args], cwd=folder, env=env, capture_output=True, text=True, timeout=300)


def test_core_stands_alone(core):
    done = python(core, "-c", "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), [x for x in q if x.startswith('op') or x == 'pipeline'])")
    assert done.returncode == 0 and done.stdout.split() == [str(len(__import__("sievelake.plans.catalogue", fromlist=["x"]).QUERIES)), "True", "[]"], done.stderr
    assert not [p for p in (core / "sievelake").rglob("*.py") if "sievelake.llm" in p.read_text()]
    done = python(core, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")
    assert done.returncode == 0, done.stdout[-2000:]


def test_core_suite_passes_alone(core):
    """A part of the suite that starts a session of its own; all of it can be run in the copy likewise."""
    done = python(core, "-m", "pytest", "tests/test_rules.py", "-q", "-p", "no:cacheprovider", "-k", "test_paths or node")
    assert done.returncode == 0, done.stdout[-2000:]


def test_what_is_broken_is_not_taken_for_absent(core):
    (core / "sievelake/llm").mkdir()
    (core / "sievelake/llm/__init__.py").write_text("")
    (core / "sievelake/llm/entries.py").write_text("import no_such_dependency\n")
    (core / "corpus_pipeline.py").write_text("")
    done = python(core, "-c", "import __spark_entry__")
    assert done.returncode and "no_such_dependency" in done.stderr
    (core / "corpus_pipeline.py").unlink()
    assert python(core, "-c", "import __spark_entry__").returncode == 0
