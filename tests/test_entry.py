"""The entry point's names and SQL are read without a Spark session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_are_listed_without_spark():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 200 and set(o) <= set(q); from pyspark import SparkContext; assert SparkContext._active_spark_context is None"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
