"""The registry can be read without a Spark session."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for path in (ROOT / "clausework").rglob("*.py"):
        if "llm" not in path.parts:
            assert "clausework.llm" not in path.read_text(), path
