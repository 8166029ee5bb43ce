"""The list of queries is read before there is a Spark session."""

import subprocess
import sys
from pathlib import Path


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), 'op1_decontamination' in e.queries())"
    told = subprocess.run([sys.executable, "-B", "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert told.returncode == 0, told.stderr
    assert told.stdout.split()[-1] == "True"
