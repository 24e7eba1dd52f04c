import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_subpackage_but_not_with_a_broken_one(tmp_path):
    shutil.copytree(ROOT / "driftline", tmp_path / "driftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sum(n.startswith('op') and n[2].isdigit() for n in e.queries()), len(e.queries()) > 20)"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    assert run().stdout.split() == ["0", "True"]
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert run().returncode != 0


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "driftline").rglob("*.py"):
        if "llm" not in path.parts:
            assert "driftline.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
