"""The driver calls the entry points from its own plain session and working directory:
Python workers must not need the package on their path (the model hook ships by value)."""

import os
import subprocess
import sys
import tempfile

from conftest import ROOT

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
assert E.entry(spark).count() > 0
assert E.queries()["model_summary"](spark, "/root/testdata/sf0.001").count() > 0
print("OK")
"""


def test_entry_and_model_hook_from_plain_session_elsewhere():
    cwd = tempfile.mkdtemp(prefix="threadlens-plain-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=600)
    assert out.returncode == 0 and "OK" in out.stdout, out.stderr[-2000:]
