"""Entry points can be imported, and list what they have, before any Spark session exists."""

import subprocess
import sys
from pathlib import Path


def test_entry_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) > 100, out.stderr
