"""The entry must import without Spark's jars, a JVM or any data file."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CHECK = """
import builtins, os, glob
def refuse(*a, **k):
    raise AssertionError(f"read while importing: {a[:1]}")
import pyspark, pyspark.sql, pyspark.ml, pandas
import zipfile
zipfile.ZipFile = refuse
glob.glob = refuse
from pyspark import SparkContext
SparkContext.__init__ = refuse
import __spark_entry__ as entry
assert entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
"""


def test_entry_imports_without_jars_or_jvm():
    done = subprocess.run([sys.executable, "-c", CHECK], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
