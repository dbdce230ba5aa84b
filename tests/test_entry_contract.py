"""The driver contract works from a plain session started outside the repo
(Python workers must import the package: it is shipped with addPyFile)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
import __spark_entry__ as E
n = E.entry(spark).count()
g = E.queries()["playlist_greedy"](spark, "/root/testdata/sf0.001").count()
assert n > 0 and g > 0, (n, g)
assert set(E.oracle_sql()) <= set(E.queries())
print("OK", n, g)
"""


def test_entry_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="entry-cwd-")
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, capture_output=True, text=True, timeout=900)
    assert r.returncode == 0, r.stderr[-3000:]
    assert "OK" in r.stdout
