"""Queries that run Python in workers, from another folder, without the package on the workers' path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import os, sys, tempfile
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
for name in {names!r}:
    print("ROWS", name, e.queries()[name](spark, {tables!r}).count(), flush=True)
os._exit(0)
"""


def ran(names, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = RUN.format(repo=REPO, names=names, tables="/root/testdata/sf0.001")
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=900)
    return dict(x.split()[1:] for x in out.stdout.splitlines() if x.startswith("ROWS")), out.stderr[-1500:]


def test_reference_queries_from_another_folder(tmp_path):
    names = ["A14_pair_density", "S2_standard_met", "S9_tar_members", "S10_spectra"]
    rows, said = ran(names, tmp_path)
    assert list(rows) == names and all(int(n) > 0 for n in rows.values()), said
