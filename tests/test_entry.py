"""The driver's entry without the training-data operators, and with broken ones."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def imported(folder):
    code = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline')[:3], len(e.queries()) > 40, set(e.oracle_sql()) <= set(e.queries()))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)


@pytest.mark.parametrize("left", ["nothing", "cache"])
def test_entry_without_the_subpackage(tmp_path, left):
    shutil.copytree(ROOT / "factloom", tmp_path / "factloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left == "cache":
        (tmp_path / "factloom" / "llm" / "__pycache__").mkdir(parents=True)
    got = imported(tmp_path)
    assert got.stdout.strip() == "[] True True", got.stderr


def test_a_broken_import_is_not_hidden(tmp_path):
    shutil.copytree(ROOT / "factloom", tmp_path / "factloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "factloom" / "llm").mkdir()
    (tmp_path / "factloom" / "llm" / "registry.py").write_text("import nothing_of_this_name")
    (tmp_path / "corpus_pipeline.py").write_text("")
    got = imported(tmp_path)
    assert got.returncode and "nothing_of_this_name" in got.stderr
