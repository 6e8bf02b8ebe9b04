"""The driver imports the entry before it has a session."""

import os
import subprocess
import sys


def test_imports_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 90, len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
