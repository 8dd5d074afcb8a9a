from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 90


def test_entry(spark):
    import __spark_entry__ as e

    found = e.entry(spark)
    assert found.columns[-2:] == ["change_type", "copies"]
    counts = {r.change_type: r["count"] for r in found.groupBy("change_type").count().collect()}
    # Measured on the smallest data: one twentieth of 1,500 orders each, old names of renames twice.
    assert counts == {"ADDED": 75, "MODIFIED": 75, "RENAMED": 75, "DELETED": 150}
