import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "headline_by_lang" in queries


def test_entry_runs(spark):
    assert entry.entry(spark).columns[0] == "lang"


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout) > 100


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "verso").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "verso").parts:
            assert "verso.llm" not in path.read_text(encoding="utf-8"), path
