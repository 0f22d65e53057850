import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
from shelfsort.session import build_session
from shelfsort.functions.fuzz import token_sort_ratio
spark = build_session(master="local[2]", shuffle_partitions=2)
df = spark.createDataFrame([("caft beer", "craft beer")], "a string, b string")
print(round(df.select(token_sort_ratio("a", "b")).first()[0], 4))
"""


def test_udfs_work_outside_the_repo_directory(tmp_path):
    """Executors' Python workers get the package shipped (addPyFile), so UDFs
    unpickle even when the working directory does not contain it."""
    out = subprocess.run([sys.executable, "-c", CODE], cwd=str(tmp_path), capture_output=True,
                         text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.strip().splitlines()[-1] == "94.7368"
