import subprocess
import sys
from pathlib import Path


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 90
