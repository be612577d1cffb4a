"""The entry points with and without the part that can be left out."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), set(e.oracle_sql()) <= set(e.queries()))"


def entry(folder):
    found = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True)
    return found.stdout.split() or found.stderr


def copied(tmp_path):
    for name in ("tablegauge", "catalog"):
        shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_without_the_text_operators(tmp_path):
    from catalog.queries import queries

    assert entry(copied(tmp_path)) == [str(len(queries())), str(len(queries())), "True"]


def test_a_folder_without_a_package_is_none(tmp_path):
    folder = copied(tmp_path)
    (folder / "tablegauge" / "llm" / "__pycache__").mkdir(parents=True)
    assert entry(folder)[-1] == "True"


def test_a_broken_part_is_an_error(tmp_path):
    folder = copied(tmp_path)
    (folder / "tablegauge" / "llm").mkdir()
    (folder / "tablegauge" / "llm" / "__init__.py").write_text("")
    (folder / "tablegauge" / "llm" / "registry.py").write_text("import corpus_pipeline\n")
    assert "No module named 'corpus_pipeline'" in entry(folder)
