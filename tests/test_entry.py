"""The entry module as a driver reads it: before any session exists."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    assert all(int(n) > 0 for n in said.stdout.split()[-2:])
