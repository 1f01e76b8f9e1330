"""Python workers get the package wherever the driver was started."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
from stratalens.operators import logit
cells = spark.createDataFrame([("o", 0, 4.0, 1.0, 4), ("o", 1, 4.0, 3.0, 4)], "outcome string, f int, w double, wy double, n long")
print("fits", logit.svy_logistic(cells, ["outcome"], logit.Formula({{"f": [0, 1]}})).count())
"""


def test_workers_import_the_package_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "fits 1" in done.stdout, done.stderr[-2000:]
