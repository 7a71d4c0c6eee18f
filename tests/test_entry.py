"""The driver contract, started from another folder."""
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as entry
from turnweave.runtime import local_session
spark = local_session(2)
# The matrix is folded in Python workers, which must find the package without PYTHONPATH.
assert entry.queries()["e20_correlation_matrix"](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_workers_need_no_copy_of_the_repository(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, check=True)
