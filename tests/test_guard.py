"""The entry point without the corpus operators: the rest must import and be all there."""

import os
import shutil
import subprocess
import sys

import pytest

from marginalia import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


ENTRY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


def copied(tmp_path, *without):
    """The repository as it is, without some of its folders and files."""
    skip = shutil.ignore_patterns("__pycache__", ".git", ".pytest_cache")

    def ignore(folder, names):
        return {n for n in names if os.path.relpath(os.path.join(folder, n), ROOT) in without} | skip(folder, names)

    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignore)
    return tmp_path / "copy"


def run(at, *command):
    return subprocess.run([sys.executable, "-B", *command], cwd=at, env=os.environ | {"PYTHONPATH": str(at)}, capture_output=True, text=True, timeout=600)


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_the_add_on(tmp_path, pipeline):
    """Both folders deleted, the pipeline's file left or not: the entry point imports and all other queries are there."""
    at = copied(tmp_path, "marginalia/llm", "tests/llm", *([] if pipeline else ["corpus_pipeline.py"]))
    got = run(at, "-c", ENTRY)
    assert got.stdout.split() == [str(len(registry.queries())), str(len(registry.oracle_sql())), "False"], got.stderr


def test_the_rest_passes_without_the_add_on(tmp_path):
    at = copied(tmp_path, "marginalia/llm", "tests/llm", "corpus_pipeline.py")
    got = run(at, "-m", "pytest", "-q", "-x", "tests/test_sections.py", "tests/test_operators.py")
    assert got.returncode == 0, got.stdout[-2000:]


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/marginalia/llm"), reason="the add-on is not here")
def test_a_missing_library_is_no_missing_add_on(tmp_path):
    at = copied(tmp_path)
    (at / "xxhash.py").write_text("raise ModuleNotFoundError('no xxhash', name='xxhash')")
    got = run(at, "-c", ENTRY)
    assert got.returncode != 0 and "xxhash" in got.stderr


def test_nothing_else_imports_the_add_on():
    for d, dirs, files in os.walk(f"{ROOT}/marginalia"):
        dirs[:] = [x for x in dirs if x not in ("llm", "__pycache__")]
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(d, f)) as h:
                    assert "llm import" not in h.read(), f
