"""The package reaches Python workers from any working folder."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pressline.functions import text
from pressline.session import local_session, prepare
from pyspark.sql import functions as F
spark = prepare(local_session("1"))
rows = spark.createDataFrame([("a &amp; b &eacute;",)], "t string")
print("GOT", rows.select(text.clean_text(F.col("t"))).first()[0])
"""


def test_operators_run_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "GOT a & b é" in run.stdout, run.stderr[-2000:]
