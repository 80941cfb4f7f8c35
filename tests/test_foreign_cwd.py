"""The Python-side tile scorer must work when workers cannot import this package."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})          # the driver finds the package; the workers do not
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
import __spark_entry__ as se
n = se.queries()["knn_euclidean"](spark, "/root/testdata/sf0.001").count()
print("ROWS", n)
"""


def test_knn_runs_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="equiclass-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS 2500" in out.stdout, out.stderr[-2000:]
