"""Importing the driver contract touches no jar, table or session."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

CHECK = """
import pathlib, zipfile
def refuse(*a, **k): raise AssertionError("import reads a file")
pathlib.Path.glob = zipfile.ZipFile.__init__ = refuse
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert set(e.oracle_sql()) <= set(e.queries())
assert SparkSession.getActiveSession() is None
"""


def test_import_is_pure():
    subprocess.run([sys.executable, "-c", CHECK], cwd=ROOT, check=True)
